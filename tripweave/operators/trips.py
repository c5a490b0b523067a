"""Operators over the trip table: derived columns, filters, facets, KPIs, snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tripweave import fixed_values as fv
from tripweave.functions import (finite_or_null, km_per_l_of_trip, nonzero, py_round, ratio,
                                 settled, sources_of)

REGEN = fv.REGEN_STATES


def is_sensor() -> Column:
    return F.array_contains("sources", fv.SENSOR_SOURCE)


def is_cloud() -> Column:
    return F.array_contains("sources", fv.CLOUD_SOURCE)


def derive_sources(trips: DataFrame) -> DataFrame:
    return trips.withColumn("sources", sources_of())


def trip_projection(trips: DataFrame) -> DataFrame:
    """Read-side columns: sources, fuel fallback, economy, cost, default state."""
    l100 = F.coalesce(nonzero("l100km"),
                      ratio(nonzero("cloud_fuel_l"), nonzero("distance_km")) * 100.0)
    state = F.coalesce(F.col("dpf_state"), F.when(F.col("source") != fv.CLOUD_STORED, F.lit("idle")))
    return (derive_sources(trips)
            .withColumn("_l100", l100)
            .withColumn("fuel_l", F.coalesce(nonzero("fuel_l"), F.col("cloud_fuel_l")))
            .withColumn("l100km", py_round(nonzero("_l100"), 2))
            .withColumn("kml", F.when(F.col("_l100") > 0, py_round(ratio(F.lit(100.0), "_l100"), 2)))
            .withColumn("cost", nonzero("cloud_fuel_l") * nonzero("price_fuel"))
            .withColumn("dpf_state", state)
            .withColumn("maintenance_passed", F.coalesce("maintenance_passed", F.lit(False)))
            .withColumn("alerts", F.coalesce("alerts", F.expr("cast(array() as array<int>)")))
            .drop("_l100"))


def sanitize_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in doubles, also inside arrays and maps of doubles."""
    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return finite_or_null(c)
        if isinstance(t, T.ArrayType) and _has_double(t.elementType):
            return F.transform(c, lambda x: clean(x, t.elementType))
        if isinstance(t, T.MapType) and _has_double(t.valueType):
            return F.transform_values(c, lambda _, x: clean(x, t.valueType))
        if isinstance(t, T.StructType) and _has_double(t):
            parts = [clean(c[f.name], f.dataType).alias(f.name) for f in t.fields]
            return F.when(c.isNotNull(), F.struct(*parts))
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _has_double(t: T.DataType) -> bool:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(t, T.ArrayType):
        return _has_double(t.elementType)
    if isinstance(t, T.MapType):
        return _has_double(t.valueType)
    return isinstance(t, T.StructType) and any(_has_double(f.dataType) for f in t.fields)


def trips_filter(trips: DataFrame, facet: str = "all") -> DataFrame:
    """Facets: all, a source label, alerts, regen."""
    if facet == "alerts":
        return trips.filter(F.size("alerts") > 0)
    if facet == "regen":
        return trips.filter(F.col("dpf_state").isin(*REGEN))
    if facet in (fv.SENSOR_SOURCE, fv.CLOUD_SOURCE):
        return trips.filter(F.array_contains("sources", facet))
    return trips


def trips_search(trips: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of file name, start or cloud id."""
    q = text.lower()
    start = F.date_format(F.col("start"), "yyyy-MM-dd'T'HH:mm:ss")
    return trips.filter(F.lower(F.coalesce("filename", F.lit(""))).contains(q)
                        | F.lower(F.coalesce(start, F.lit(""))).contains(q)
                        | F.coalesce(F.col("cloud_id").cast("string"), F.lit("")).contains(q))


def source_split(trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sensor trips, cloud trips without sensor data)."""
    return trips.filter(is_sensor()), trips.filter(is_cloud() & ~is_sensor())


def session_min_filter(trips: DataFrame, minimum: float = 0.5) -> DataFrame:
    return trips.filter(F.coalesce(F.col("distance_km"), F.lit(0.0)) >= minimum)


def plausible_economy(trips: DataFrame, low: float = 2.0, high: float = 60.0) -> DataFrame:
    """Trips with a plausible km/L, with that value as ``economy``."""
    return (trips.withColumn("economy", km_per_l_of_trip())
            .filter((F.col("economy") > low) & (F.col("economy") < high)))


def regen_history(trips: DataFrame) -> DataFrame:
    return trips.filter(is_sensor() & (F.col("dpf_state") != "idle"))


def trips_latest_first(trips: DataFrame) -> DataFrame:
    return trips.orderBy(F.desc_nulls_last("start"), F.desc("trip_id"))


def recent_k(trips: DataFrame, k: int = 5) -> DataFrame:
    return trips_latest_first(trips).limit(k)


def last_regen(trips: DataFrame) -> DataFrame:
    """Latest completed regeneration per vehicle."""
    done = trips.filter(is_sensor() & (F.col("dpf_state") == "completed"))
    key = F.struct("start", "trip_id")
    return done.groupBy("vehicle_id").agg(F.max_by("trip_id", key).alias("trip_id"),
                                          F.max("start").alias("start"))


def peak_egt(trips: DataFrame) -> DataFrame:
    return trips.filter(is_sensor()).groupBy("vehicle_id").agg(
        F.max("exhaust_after_cat_c").alias("peak_egt_c"))


def fleet_kpis(trips: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals over all trips, per ``keys`` or global.  Partial + final aggregation."""
    priced = is_cloud() & (F.col("price_fuel") != 0)
    totals = trips.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum(F.coalesce("distance_km", F.lit(0.0))).alias("total_km"),
        F.sum(F.coalesce("duration_min", F.lit(0.0))).alias("total_min"),
        F.sum(F.coalesce("fuel_l", F.lit(0.0))).alias("total_fuel_l"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("total_cost"),
        F.avg(F.when(priced, F.col("price_fuel"))).alias("avg_fuel_price"),
        F.count_if(is_sensor()).alias("sensor_trips"), F.count_if(is_cloud()).alias("cloud_trips"))
    economy = ratio(settled("total_km"), settled("total_fuel_l"))
    return totals.withColumn("km_per_l", F.coalesce(economy, F.lit(0.0)))


def cloud_kpis(trips: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals over cloud trips, with alert total and number of distinct codes.

    Distinct codes are counted on exploded (key, code) pairs, so no set of alert
    arrays grows in an aggregation buffer.
    """
    cloud = trips.filter(is_cloud()).withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    totals = cloud.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("total_cost"),
        F.sum(F.coalesce("fuel_l", F.lit(0.0))).alias("total_fuel_l"),
        F.sum(F.coalesce("distance_km", F.lit(0.0))).alias("total_km"),
        F.avg(nonzero("price_fuel")).alias("avg_price"),
        F.sum(F.size("alerts")).cast("bigint").alias("alerts"))
    codes = (cloud.select(*by, F.explode("alerts").alias("code")).distinct()
             .groupBy(*by).agg(F.count(F.lit(1)).alias("distinct_alerts")))
    return (totals.join(codes, by, "left").drop("_all")
            .withColumn("distinct_alerts", F.coalesce("distinct_alerts", F.lit(0))))


def alert_table(spark) -> DataFrame:
    """Alert code, severity, label: a fixed dimension of 124 rows."""
    return spark.createDataFrame(fv.ALERTS, "code int, severity string, label string")


def alert_lookup(codes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Severity and label per code; an unknown code stays, as info ``#code``."""
    return (codes.join(alerts, "code", "left")
            .withColumn("severity", F.coalesce("severity", F.lit("info")))
            .withColumn("label", F.coalesce("label", F.concat(F.lit("#"), F.col("code").cast("string")))))


def alert_frequency(trips: DataFrame, alerts: DataFrame) -> DataFrame:
    """Occurrences per code; counted before the lookup, so the join is tiny."""
    counts = (trips.filter(is_cloud()).select(F.explode("alerts").alias("code"))
              .groupBy("code").agg(F.count(F.lit(1)).alias("occurrences")))
    return alert_lookup(counts, alerts)


def facet_counts(trips: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return trips.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("all"), F.count_if(is_sensor()).alias("sensor"),
        F.count_if(is_cloud()).alias("cloud"),
        F.count_if(F.col("dpf_state").isin(*REGEN)).alias("regen"),
        F.count_if(F.size("alerts") > 0).alias("with_alerts"))


def vehicle_snapshot(trips: DataFrame) -> DataFrame:
    """Latest state per vehicle.

    Newest trip: odometer.  Newest cloud trip: fuel and service, a 0 or null
    falling through to the newest sensor trip.  Newest sensor trip: the rest.
    """
    key = F.struct("start", "trip_id")

    def newest(cond, fields):
        return F.max_by(F.struct(*fields), F.when(cond, key))

    service = ["fuel_level", "fuel_autonomy", "days_to_service", "km_to_service",
               "maintenance_passed"]
    sensor = ["adblue_range_km", "dpf_closed_soot", "dpf_avg_regen_km", "dpf_since_regen_km",
              "dpf_replace_km", "dpf_regen_capability", "dpf_state", "oil_dilution_pct",
              "battery_startup_v"]
    has_vin = is_cloud() & (F.coalesce("vin", F.lit("")) != "")
    rows = trips.groupBy("vehicle_id").agg(
        F.max_by("odometer_km", key).alias("odometer_km"),
        newest(is_cloud(), service).alias("c"), newest(is_sensor(), service + sensor).alias("s"),
        F.max_by("vin", F.when(has_vin, key)).alias("vin"))
    picked = [F.coalesce(nonzero(F.col(f"c.{f}")), nonzero(F.col(f"s.{f}"))).alias(f)
              for f in service[:4]]
    passed = F.coalesce("c.maintenance_passed", F.lit(False)) | F.coalesce(
        "s.maintenance_passed", F.lit(False))
    return rows.select("vehicle_id", F.coalesce("vin", F.lit("")).alias("vin"), "odometer_km",
                       *picked, passed.alias("service_passed"),
                       *[F.col(f"s.{f}").alias(f) for f in sensor])


def period_aggregates(trips: DataFrame, unit: str = "month") -> DataFrame:
    """Sums and means per vehicle and calendar period."""
    return trips.groupBy("vehicle_id", F.date_trunc(unit, "start").cast("timestamp_ntz")
                         .alias("period")).agg(
        F.count(F.lit(1)).alias("trips"), F.sum("distance_km").alias("distance_km"),
        F.sum("fuel_l").alias("fuel_l"), F.sum("cost").alias("cost"),
        F.avg("distance_km").alias("mean_distance_km"))


def slim_trips(trips: DataFrame) -> DataFrame:
    """Summary extract without the heavy nested columns."""
    heavy = [c for c in ("pid_catalog", "pid_values", "pid_series", "track") if c in trips.columns]
    extra = []
    if "track" in trips.columns:
        extra.append((F.coalesce(F.size("track"), F.lit(0)) > 0).alias("has_track"))
    if "pid_values" in trips.columns:
        extra.append(F.greatest(F.size("pid_values"), F.lit(0)).alias("pid_count"))
    return trips.select(*[c for c in trips.columns if c not in heavy + ["pid_count"]], *extra)


def get_trip(trips: DataFrame, trip_id) -> DataFrame:
    return trips.filter(F.col("trip_id") == F.lit(trip_id))


def unify_sources(sensor_trips: DataFrame, cloud_trips: DataFrame) -> DataFrame:
    return sensor_trips.unionByName(cloud_trips, allowMissingColumns=True)
