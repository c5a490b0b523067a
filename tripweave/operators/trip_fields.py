"""Trip summary fields from windowed samples: curated fields, integrals, distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tripweave import fixed_values as fv
from tripweave.functions import end_time, l_per_100, nonzero, py_round
from tripweave.operators import ordered as o
from tripweave.operators.samples import correction_table, windowed_samples

MIN_TRIP_KM = 1.0
MIN_ODOMETER_KM = 2.0
MAX_ODOMETER_KM = 2000.0
# filled in when cloud legs are matched to the trip
CLOUD_COLUMNS = {
    "cloud_id": "bigint", "cloud_fuel_l": "double", "price_fuel": "double", "fuel_level": "bigint",
    "fuel_autonomy": "bigint", "days_to_service": "bigint", "km_to_service": "bigint", "vin": "string",
}
_AGG_COLUMN = {"mean": "mean", "max": "hi", "min": "lo", "first": "first", "last": "last"}


def sensor_aggregates(windowed: DataFrame) -> DataFrame:
    """mean, max, min, first, last per (trip, sensor) in one hash aggregation."""
    return windowed.groupBy("trip_id", "pid").agg(
        F.avg("value").alias("mean"), F.max("value").alias("hi"), F.min("value").alias("lo"),
        F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last"),
        F.count(F.lit(1)).alias("samples"))


def curated_fields(windowed: DataFrame,
                   fields: Sequence[tuple[str, str, Sequence[str]]] = fv.TRIP_FIELDS) -> DataFrame:
    """One column per field: the aggregate of the first listed sensor with samples."""
    wanted = sorted({pid for _, _, pids in fields for pid in pids})
    per_sensor = sensor_aggregates(windowed.filter(F.col("pid").isin(*wanted)))
    columns = [F.coalesce(*[F.max(F.when(F.col("pid") == pid, F.col(_AGG_COLUMN[how])))
                            for pid in pids]).alias(name)
               for name, how, pids in fields]
    return per_sensor.groupBy("trip_id").agg(*columns)


def integrate(windowed: DataFrame, pids: Sequence[str]) -> DataFrame:
    """Trapezoid integral of an hourly rate per (trip, sensor), unrounded, floor 0.

    Neighbours are paired inside (trip, sensor, chunk); one summary row per chunk
    supplies the strip between chunks.  Null with fewer than two samples.
    """
    rates = windowed.filter(F.col("pid").isin(*pids))
    w = Window.partitionBy("trip_id", "pid", "chunk").orderBy("seq")
    strip = ((F.col("sec") - F.lag("sec").over(w)) / 3600.0
             * (F.col("value") + F.lag("value").over(w)) / 2.0)
    per_chunk = (rates.select("trip_id", "pid", "chunk", "seq", "sec", "value", strip.alias("strip"))
                 .groupBy("trip_id", "pid", "chunk")
                 .agg(F.sum("strip").alias("area"), F.count(F.lit(1)).alias("n"),
                      F.min_by("sec", "seq").alias("sec0"), F.min_by("value", "seq").alias("v0"),
                      F.max_by("sec", "seq").alias("sec1"), F.max_by("value", "seq").alias("v1")))
    c = Window.partitionBy("trip_id", "pid").orderBy("chunk")
    bridge = ((F.col("sec0") - F.lag("sec1").over(c)) / 3600.0
              * (F.col("v0") + F.lag("v1").over(c)) / 2.0)
    area = F.coalesce(F.sum("area"), F.lit(0.0)) + F.coalesce(F.sum("bridge"), F.lit(0.0))
    return (per_chunk.withColumn("bridge", bridge).groupBy("trip_id", "pid")
            .agg(area.alias("area"), F.sum("n").alias("samples"))
            .select("trip_id", "pid", "samples",
                    F.when(F.col("samples") >= 2, F.greatest(F.col("area"), F.lit(0.0)))
                    .alias("integral")))


def odometer_delta(windowed: DataFrame, pid: str = fv.ODOMETER,
                   high: float = MAX_ODOMETER_KM) -> DataFrame:
    """Last minus first reading when it lies in (0, high)."""
    ends = (windowed.filter(F.col("pid") == pid).groupBy("trip_id")
            .agg(F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last"),
                 F.count(F.lit(1)).alias("n")))
    d = F.col("last") - F.col("first")
    return ends.select("trip_id", F.when((F.col("n") >= 2) & (d > 0) & (d < high), d)
                       .alias("odo_delta_km"))


def resolve_distance(trips: DataFrame, counter="distance_km_raw", odometer="odo_delta_km",
                     gps="gps_km", min_odometer: float = MIN_ODOMETER_KM) -> DataFrame:
    """Trip counter, else odometer difference, else GPS integral; with its label."""
    by_counter = F.col(counter) > 0
    by_odometer = F.col(odometer) >= min_odometer
    return (trips
            .withColumn("distance_km", F.when(by_counter, F.col(counter))
                        .when(by_odometer, F.col(odometer)).otherwise(F.col(gps)))
            .withColumn("distance_source", F.when(by_counter, F.lit("trip_counter"))
                        .when(by_odometer, F.lit("odometer")).otherwise(F.lit("gps"))))


def short_trip_filter(trips: DataFrame, distance="distance_km",
                      minimum: float = MIN_TRIP_KM) -> DataFrame:
    return trips.filter(F.coalesce(F.col(distance), F.lit(0.0)) >= minimum)


def trip_totals(windowed: DataFrame, windows: DataFrame, fields=fv.TRIP_FIELDS,
                fuel_pid: str = fv.FUEL_RATE, speed_pid: str = fv.GPS_SPEED,
                odometer_pid: str = fv.ODOMETER, minimum_km: float = MIN_TRIP_KM,
                rounded: bool = True) -> DataFrame:
    """Trip rows (unrounded fields) with window, fuel, distance; short trips dropped."""
    areas = integrate(windowed, [fuel_pid, speed_pid]).groupBy("trip_id").agg(
        F.max(F.when(F.col("pid") == fuel_pid, F.col("integral"))).alias("fuel_l"),
        F.max(F.when(F.col("pid") == speed_pid, F.col("integral"))).alias("gps_km"))
    # the odometer's ends come out of the same aggregation as the curated fields
    ends = [("_odo_first", "first", [odometer_pid]), ("_odo_last", "last", [odometer_pid])]
    delta = F.col("_odo_last") - F.col("_odo_first")
    curated = (curated_fields(windowed, [*fields, *ends])
               .withColumn("odo_delta_km", F.when((delta > 0) & (delta < MAX_ODOMETER_KM), delta))
               .drop("_odo_first", "_odo_last"))

    def r(c, digits):
        return py_round(c, digits) if rounded else F.col(c)

    joined = (windows.join(curated, "trip_id", "left").join(areas, "trip_id", "left")
              .withColumn("fuel_l", r("fuel_l", 3)).withColumn("gps_km", r("gps_km", 2))
              .withColumn("odo_delta_km", r("odo_delta_km", 2)))
    out = short_trip_filter(resolve_distance(joined), minimum=minimum_km)
    return out.withColumn("duration_min", (F.col("t_end") - F.col("t_start")) / 60.0)


def round_fields(trips: DataFrame) -> DataFrame:
    """Stored form of the fields: fixed digits, and 0 as "not measured" where due."""
    rounded = {name: py_round(name, digits) for name, digits in fv.TRIP_FIELD_DIGITS.items()}
    return trips.withColumns({
        **rounded,
        "avg_rpm": nonzero("avg_rpm").cast("int"), "max_rpm": nonzero("max_rpm").cast("int"),
        "odometer_km": py_round(nonzero("odometer_km"), 0).cast("int"),
        "ss_state": nonzero("ss_state").cast("int"),
        "l100km": py_round(l_per_100("fuel_l", "distance_km"), 2),
        "distance_km": py_round("distance_km", 2)})


def trip_summaries(samples: DataFrame, files: DataFrame, spark) -> DataFrame:
    """Sensor samples in, stored trip rows out (the whole per-file derivation).

    ``files`` is (trip_id, vehicle_id, filename, start, start_utc).
    """
    from tripweave.operators.dpf import DpfRules, dpf_state
    from tripweave.operators.pid_stats import slug_table, with_slug

    windows, windowed = windowed_samples(samples, corrections=correction_table(spark))
    trips = round_fields(trip_totals(windowed, windows))
    states = dpf_state(windowed, DpfRules())
    trips = trips.join(states.select("trip_id", "dpf_state", "dpf_regen_active"), "trip_id", "left")
    sensors = windowed.groupBy("trip_id", "pid").agg(F.count(F.lit(1)).alias("n"))
    counts = (with_slug(sensors, slug_table(spark)).select("trip_id", "slug").distinct()
              .groupBy("trip_id").agg(F.count(F.lit(1)).alias("pid_count")))
    return (files.join(trips, "trip_id").join(counts, "trip_id")
            .withColumn("source", F.lit(fv.SENSOR_STORED))
            .withColumn("end", end_time("start", "duration_min"))
            .withColumn("duration_min", py_round("duration_min", 1))
            .withColumn("dpf_state", F.coalesce("dpf_state", F.lit("idle")))
            .withColumn("dpf_regen_active", F.coalesce("dpf_regen_active", F.lit(0)))
            .withColumns({c: F.lit(None).cast(t) for c, t in CLOUD_COLUMNS.items()})
            .withColumn("alerts", F.expr("cast(array() as array<int>)"))
            .withColumn("maintenance_passed", F.lit(False))
            .drop("t_start", "t_end", "anchor", "distance_km_raw", "gps_km", "odo_delta_km",
                  "dpf_regen_status", "dpf_regen_enable"))
