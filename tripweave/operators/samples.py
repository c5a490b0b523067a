"""Operators over raw sensor samples: engine window, clipping, GPS track.

Columns used: vehicle_id, trip_id, seq (unique file order), sec, pid, value,
unit, lat, lon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tripweave import fixed_values as fv
from tripweave.functions import swap_correct
from tripweave.operators import ordered as o
from tripweave.operators.joins import salted_join


def anchor_bounds(samples: DataFrame, anchors: Sequence[str] = fv.ENGINE_ANCHORS,
                  chunk_rows: int = o.CHUNK_ROWS) -> DataFrame:
    """Per (trip, chunk): time bounds of every anchor sensor and of all rows.

    One partial aggregation over four columns.  Both the trip windows and the
    per-chunk windows are derived from it, over the same exchange.
    """
    aggs = [F.min("sec").alias("lo"), F.max("sec").alias("hi")]
    for i, anchor in enumerate(anchors):
        at = F.when(F.col("pid") == anchor, F.col("sec"))
        aggs += [F.min(at).alias(f"lo{i}"), F.max(at).alias(f"hi{i}")]
    return (samples.withColumn("chunk", o.chunk_by_sequence("seq", chunk_rows))
            .groupBy("trip_id", "chunk").agg(*aggs))


def _first_present(anchors: Sequence[str], lowest, highest) -> list:
    n = range(len(anchors))
    return [F.coalesce(*[lowest(f"lo{i}") for i in n], lowest("lo")).alias("t_start"),
            F.coalesce(*[highest(f"hi{i}") for i in n], highest("hi")).alias("t_end"),
            F.coalesce(*[F.when(lowest(f"lo{i}").isNotNull(), F.lit(a)) for i, a in enumerate(anchors)],
                       F.lit("")).alias("anchor")]


def engine_window(bounds: DataFrame, anchors: Sequence[str] = fv.ENGINE_ANCHORS) -> DataFrame:
    """Per trip: time bounds of the first anchor sensor present, else of all rows."""
    return bounds.groupBy("trip_id").agg(*_first_present(anchors, F.min, F.max))


def chunk_windows(bounds: DataFrame, anchors: Sequence[str] = fv.ENGINE_ANCHORS) -> DataFrame:
    """The trip's window on each of its chunks.

    A trip has one row per chunk here, so its rows in this window are fewer than
    its samples by the chunk length.
    """
    w = Window.partitionBy("trip_id")
    start, end, _ = _first_present(anchors, lambda c: F.min(c).over(w), lambda c: F.max(c).over(w))
    return bounds.select("trip_id", "chunk", start, end)


def sensor_facts(samples: DataFrame) -> DataFrame:
    """Per (trip, sensor) over the whole file: first appearance and last unit seen.

    Units are grouped first, so the large step is a hash aggregation on numbers.
    """
    units = samples.groupBy("trip_id", "pid", "unit").agg(
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
    return units.groupBy("trip_id", "pid").agg(
        F.min("min_seq").alias("first_seq"), F.max_by("unit", "max_seq").alias("unit"))


def clip_to_window(samples: DataFrame, windows: DataFrame,
                   chunk_rows: int = o.CHUNK_ROWS) -> DataFrame:
    """Samples inside their trip's window (both ends included).

    Joined on (trip, chunk), so a trip holding a large share of all rows is spread
    over as many tasks as it has chunks, and the exchange serves every later
    (trip, chunk) window.
    """
    return (samples.withColumn("chunk", o.chunk_by_sequence("seq", chunk_rows))
            .join(windows, ["trip_id", "chunk"])
            .filter(F.col("sec").between(F.col("t_start"), F.col("t_end"))))


def correction_table(spark) -> DataFrame:
    """The correction parameters as a small dimension (nine rows)."""
    rows = [(pid, *p) for pid, p in fv.CORRECTIONS.items()]
    return spark.createDataFrame(rows, "pid string, div double, mul double, ofs double")


def correct_values(samples: DataFrame, corrections: DataFrame) -> DataFrame:
    """Apply the byte-swap correction to the sensors the dimension lists.

    ``corrections`` is (pid, div, mul, ofs).
    """
    fixed_value = F.when(F.col("div").isNotNull(), swap_correct("value", "div", "mul", "ofs"))
    return (samples.join(corrections, "pid", "left")
            .withColumn("value", F.coalesce(fixed_value, F.col("value")))
            .drop("div", "mul", "ofs"))


def windowed_samples(samples: DataFrame, anchors=fv.ENGINE_ANCHORS, corrections=None,
                     chunk_rows: int = o.CHUNK_ROWS):
    """(trip windows, clipped and corrected samples)."""
    bounds = anchor_bounds(samples, anchors, chunk_rows)
    clipped = clip_to_window(samples, chunk_windows(bounds, anchors), chunk_rows)
    if corrections is not None:
        clipped = correct_values(clipped, corrections)
    return engine_window(bounds, anchors), clipped


def chunk_of(rows: DataFrame, chunk_rows: int = o.CHUNK_ROWS):
    """None for rows that were joined on (trip, chunk) already: their exchange is used again."""
    return None if "chunk" in rows.columns else o.chunk_by_sequence("seq", chunk_rows)


def gps_fixes(samples: DataFrame) -> DataFrame:
    """Rows with a position (0, 0 means "no fix")."""
    return samples.filter((F.col("lat") != 0.0) | (F.col("lon") != 0.0))


def _tracked(fixes: DataFrame, chunk_rows: int) -> DataFrame:
    """Fixes that differ from the fix just before them in the trip, with their index from 0."""
    before = Window.unboundedPreceding
    same = lambda a, b: F.col(f"{a}_lat").eqNullSafe(F.col(f"{b}_lat")) & F.col(f"{a}_lon").eqNullSafe(F.col(f"{b}_lon"))
    scanned = o.chunk_scan(
        fixes, ["trip_id"], ["seq"], chunk_of(fixes, chunk_rows),
        local=[{"_p_lat": lambda w: F.lag("lat").over(w), "_p_lon": lambda w: F.lag("lon").over(w)},
               {"_new": lambda w: (~F.col("_first") & ~(F.col("_p_lat").eqNullSafe(F.col("lat"))
                                                        & F.col("_p_lon").eqNullSafe(F.col("lon")))).cast("long")},
               {"_upto": lambda w: F.sum("_new").over(w.rowsBetween(before, 0))}],
        summary={"_n": F.sum("_new"), "_f_lat": F.min_by("lat", "seq"), "_f_lon": F.min_by("lon", "seq"),
                 "_l_lat": F.max_by("lat", "seq"), "_l_lon": F.max_by("lon", "seq")},
        carried=[{"_any": lambda w: F.lag(F.lit(1)).over(w), "_b_lat": lambda w: F.lag("_l_lat").over(w),
                  "_b_lon": lambda w: F.lag("_l_lon").over(w)},
                 {"_head": lambda w: (F.col("_any").isNull() | ~same("_f", "_b")).cast("long")},
                 {"_before": lambda w: F.coalesce(F.sum(F.col("_n") + F.col("_head")).over(w.rowsBetween(before, -1)), F.lit(0))}],
        out={"_kept": F.when(F.col("_first"), F.col("_head")).otherwise(F.col("_new")) == 1,
             "idx": F.col("_before") + F.col("_head") + F.col("_upto") - 1})
    return scanned.filter("_kept").drop("_kept")


def gps_dedup(fixes: DataFrame, chunk_rows: int = o.CHUNK_ROWS) -> DataFrame:
    """Drop fixes equal to the fix just before them in the trip."""
    return _tracked(fixes, chunk_rows).drop("idx")


def tracks(fixes: DataFrame, chunk_rows: int = o.CHUNK_ROWS) -> DataFrame:
    """Long form of the GPS track: (trip_id, idx from 0, seq, sec, lat, lon)."""
    return _tracked(fixes, chunk_rows).select("trip_id", "idx", "seq", "sec", "lat", "lon")


def gps_bbox(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("trip_id").agg(
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        F.count(F.lit(1)).alias("points"))


def series_of(samples: DataFrame, trip_id, pid: str) -> DataFrame:
    """(sec, value) of one trip and sensor; both filters reach the scan."""
    return samples.filter((F.col("trip_id") == F.lit(trip_id)) & (F.col("pid") == pid)).select(
        "seq", "sec", "value")


def values_at_time(samples: DataFrame, cursors: DataFrame) -> DataFrame:
    """Latest value of every sensor at a cursor time per trip.

    ``cursors`` is (trip_id, cursor_sec), one row per trip.
    """
    return (salted_join(samples, cursors, ["trip_id"], "seq")
            .filter(F.col("sec") <= F.col("cursor_sec"))
            .groupBy("trip_id", "pid")
            .agg(F.max_by("value", "seq").alias("value"), F.max_by("sec", "seq").alias("sec")))
