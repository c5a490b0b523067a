"""Map operators: interpolation on the track, coloured segments, events, GeoJSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripweave import fixed_values as fv
from tripweave.functions import color_ramp
from tripweave.operators import ordered as o
from tripweave.operators.joins import chunked_join

TIME_CHUNK_S = 600.0


def pid_at_gps(points: DataFrame, series: DataFrame, width: float = TIME_CHUNK_S) -> DataFrame:
    """Value of a sensor at each track point by linear interpolation in time.

    Both streams are laid on one time line; each point looks back and forward to
    the nearest sample.  Before the first and after the last sample the nearest
    value holds.  ``points`` (trip_id, idx, sec, lat, lon); ``series`` (trip_id,
    seq, sec, value).
    """
    none = lambda t: F.lit(None).cast(t)
    a = series.select("trip_id", "sec", F.lit(0).alias("kind"), F.col("seq").alias("n"), "value",
                      none("double").alias("lat"), none("double").alias("lon"))
    b = points.select("trip_id", "sec", F.lit(1).alias("kind"), F.col("idx").alias("n"),
                      none("double").alias("value"), "lat", "lon")
    sample = F.when(F.col("kind") == 0, F.struct("sec", "value"))
    line = o.ordered_scan(a.unionByName(b), ["trip_id"], ["sec", "kind", "n"],
                          o.chunk_by_time("sec", width), before=o.latest(sample),
                          after=o.upcoming(sample))
    t0, v0, t1, v1 = (F.col(c) for c in ("before.sec", "before.value", "after.sec", "after.value"))
    blend = v0 + (v1 - v0) * (F.col("sec") - t0) / (t1 - t0)
    value = (F.when(F.col("before").isNull(), v1).when(F.col("after").isNull(), v0)
             .when(F.col("sec") == t0, v0).otherwise(blend))
    return line.filter("kind = 1").select("trip_id", F.col("n").alias("idx"), "sec", "lat", "lon",
                                          value.alias("value"))


def as_of_fix(times: DataFrame, fixes: DataFrame, width: float = TIME_CHUNK_S) -> DataFrame:
    """Position at a time: the last fix at or before it, else the first after it.

    ``times`` (trip_id, n unique per trip, sec, ...); ``fixes`` (trip_id, seq,
    sec, lat, lon).
    """
    extra = [c for c in times.columns if c not in ("trip_id", "n", "sec")]
    a = fixes.select("trip_id", "sec", F.lit(0).alias("kind"), F.col("seq").alias("n"),
                     F.struct("lat", "lon").alias("fix"))
    b = times.select("trip_id", "sec", F.lit(1).alias("kind"), "n", *extra)
    line = o.ordered_scan(a.unionByName(b, allowMissingColumns=True), ["trip_id"],
                          ["sec", "kind", "n"], o.chunk_by_time("sec", width),
                          before=o.latest("fix"), after=o.upcoming("fix"))
    fix = F.coalesce("before", "after")
    return line.filter("kind = 1").select("trip_id", "n", "sec", *extra, fix["lat"].alias("lat"),
                                          fix["lon"].alias("lon"))


def pid_segments(valued: DataFrame, epsilon: float = 1e-9,
                 chunk_rows: int = o.CHUNK_ROWS) -> DataFrame:
    """Consecutive point pairs with the first point's value, its share and colour.

    A trip's extremes come along with the neighbours over the cuts, so points meet by (trip, chunk) only.
    """
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = o.chunk_scan(
        valued, ["trip_id"], ["idx"], o.chunk_by_sequence("idx", chunk_rows),
        local=[{f"_n_{c}": lambda w, c=c: F.lead(c).over(w) for c in ("lat", "lon")}
               | {"_last": lambda w: F.lead(F.lit(1)).over(w).isNull()}],
        summary={"_f_lat": F.min_by("lat", "idx"), "_f_lon": F.min_by("lon", "idx"), "_c_lo": F.min("value"), "_c_hi": F.max("value")},
        carried=[{"_a_lat": lambda w: F.lead("_f_lat").over(w), "_a_lon": lambda w: F.lead("_f_lon").over(w),
                  "_t_lo": lambda w: F.min("_c_lo").over(w.rowsBetween(*whole)),
                  "_t_hi": lambda w: F.max("_c_hi").over(w.rowsBetween(*whole))}],
        out={"lat2": F.when(F.col("_last"), F.col("_a_lat")).otherwise(F.col("_n_lat")),
             "lon2": F.when(F.col("_last"), F.col("_a_lon")).otherwise(F.col("_n_lon")),
             "_lo": F.col("_t_lo"), "_hi": F.col("_t_hi")})
    norm = (F.col("value") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(epsilon))
    return (nxt.filter(F.col("lat2").isNotNull()).withColumn("normalized", norm)
            .withColumn("color", color_ramp("normalized")).drop("_lo", "_hi"))


@dataclass(frozen=True)
class EventRules:
    sensors: dict = field(default_factory=lambda: {
        "regen": fv.DPF_SENSORS["status"], "egt": fv.DPF_SENSORS["egt_after"],
        "speed": fv.GPS_SPEED, "coolant": fv.COOLANT})
    regen_level: float = 1.0
    speed_limit: float = 130.0
    cold_below: float = 40.0


def trip_events(samples: DataFrame, rules: EventRules = EventRules()) -> DataFrame:
    """Regeneration start and end, hottest exhaust, speeding, cold start, as
    (trip_id, category, seq, sec, value)."""
    s = rules.sensors

    def pick(category: str, cond: Column, how) -> DataFrame:
        hit = samples.filter(cond).groupBy("trip_id").agg(
            how("sec").alias("sec"), how("value").alias("value"), how("seq").alias("seq"))
        return hit.select("trip_id", F.lit(category).alias("category"), "seq", "sec", "value")

    first = lambda c: F.min_by(c, "seq")
    last = lambda c: F.max_by(c, "seq")
    peak = lambda c: F.max_by(c, F.struct(F.col("value"), -F.col("seq")))
    pid, v = F.col("pid"), F.col("value")
    regen = (pid == s["regen"]) & (v >= rules.regen_level)
    speeding = samples.filter((pid == s["speed"]) & (v > rules.speed_limit)).select(
        "trip_id", F.lit("speeding").alias("category"), "seq", "sec", "value")
    parts = [pick("regen_start", regen, first), pick("regen_end", regen, last),
             pick("max_egt", pid == s["egt"], peak), speeding,
             pick("cold_start", (pid == s["coolant"]) & (v < rules.cold_below), first)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def line_features(points: DataFrame, properties: DataFrame | None = None,
                  points_per_line: int | None = None) -> DataFrame:
    """GeoJSON LineString per trip, as text.

    With ``points_per_line`` a line holds at most so many segments; the cut point closes
    one part and opens the next, so the parts join into the whole path.
    """
    size = F.lit(points_per_line or 1 << 62)
    part = F.floor(F.col("idx") / size).cast("bigint")
    cut = (F.col("idx") % size == 0) & (F.col("idx") > 0)
    parts = points.withColumn("part", F.explode(
        F.when(cut, F.array(part - 1, part)).otherwise(F.array(part))))
    lines = parts.groupBy("trip_id", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", F.array("lon", "lat").alias("p")))),
                    lambda x: x["p"]).alias("coordinates"))
    if properties is not None:
        lines = lines.join(properties, "trip_id", "left")
        props = F.struct("trip_id", *[c for c in properties.columns if c != "trip_id"])
    else:
        props = F.struct("trip_id")
    return lines.select("trip_id", "part", F.size("coordinates").alias("points"), F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry"),
        props.alias("properties"))).alias("feature"))


def point_features(events: DataFrame) -> DataFrame:
    """GeoJSON Point per event with a position, as text."""
    return events.select("trip_id", "n", F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
        .alias("geometry"),
        F.struct("category", "value").alias("properties"))).alias("feature"))


def hydrate_tracks(trips: DataFrame, points: DataFrame) -> DataFrame:
    """Track points with their trip's summary columns; a long track spreads over its pieces."""
    return chunked_join(points, trips, "trip_id", "idx")
