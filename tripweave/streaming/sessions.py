"""Live samples to engine sessions: all sensor statistics and the filter state, while a session runs and when it closes.

Two levels.  A keyed state processor holds the samples of one (bucket of vehicles, time chunk) until the watermark has passed
the chunk; then a timer closes it and its state is cleared.  A call of the processor costs milliseconds whatever it holds, so
vehicles share one by a hash; every step works on the columns of all of them at once.  After every micro-batch a touched chunk
of a vehicle hands on what later levels need, already summed: its samples are cut at pauses (segments) and, inside a segment, at the first
and last sample of every anchor sensor (zones).  Whatever the engine window of the whole session will be, a zone
lies inside or outside of it as a whole, so summaries by zone are enough and nothing is computed twice.

The second level joins segments to sessions and zones to windows over these summaries, with the batch operators for the
rest.  The order of samples is (time, seq); results equal the batch operators' over the same rows, in whatever order
and batches the rows arrived.  Samples later than the watermark are dropped by the stream; running the batch
operators over the stored samples brings them in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tripweave import fixed_values as fv
from tripweave.operators import dpf, ordered as o, pid_stats as ps

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: samples that share a state key, over all of its chunks
BUCKET_ROWS = 16_384

_KEYS = ["vehicle_id", "chunk"]
#: one row per (segment, zone, sensor, value rounded to 0.1), one per zone with the filter's distance readings, one per closing
SUMMARY = ("vehicle_id {vehicle}, chunk long, segment int, zone int, zone_first double, zone_last double, pid string, "
           "rounded double, n long, n_on long, total double, lo double, hi double, first_us long, first_seq long, "
           "last_us long, last_seq long, first_value double, last_value double, whole boolean, int_lo double, "
           "int_hi double, unit string, readings array<double>, closed boolean")
_BLOCK = pa.schema([("us", pa.int64()), ("seq", pa.int64()), ("pid", pa.string()), ("value", pa.float64()), ("unit", pa.string()),
                    ("vehicle", pa.string())])
_NAMES = [c.split()[0] for c in SUMMARY.split(", ")]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the one before them, the first row included."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _zones(sec: np.ndarray, pid: np.ndarray, anchors: Sequence[str], segment: np.ndarray | None = None) -> np.ndarray:
    """Zone of every sample of its segment: the cuts are points, and what lies between two of them is a zone too.

    Samples are ordered by segment and time.
    """
    segment = np.zeros(len(sec), np.int64) if segment is None else segment
    point = np.cumsum(_changes(segment, sec)) - 1                              # samples of one time
    cut = np.zeros(point[-1] + 1, bool)
    for anchor in anchors:
        at = np.flatnonzero(pid == anchor)
        if len(at):
            first = _changes(segment[at])
            cut[point[at[first]]] = cut[point[at[np.append(first[1:], True)]]] = True
    before = (np.cumsum(cut) - cut)[point]
    opens = _changes(segment)
    return 2 * (before - before[opens][np.cumsum(opens) - 1]) + cut[point]


def summarise(us: np.ndarray, seq: np.ndarray, pid: np.ndarray, value: np.ndarray, unit: np.ndarray,
              anchors: Sequence[str], gap_s: float, distance: str, level: float,
              vehicle: np.ndarray | None = None) -> dict[str, np.ndarray | list]:
    """Columns of the summary rows (without chunk and closed) of one chunk's samples, which may be in any order.

    With ``vehicle`` the samples are those of many vehicles, and the rows say whose they are.
    """
    owner = np.zeros(len(us), np.int64) if vehicle is None else pd.factorize(vehicle, use_na_sentinel=False)[0]
    order = np.lexsort((seq, us, owner))
    us, seq, pid, value, unit, owner = us[order], seq[order], pid[order], value[order], unit[order], owner[order]
    n, sec = len(us), us / 1e6
    starts = _changes(owner)
    every = np.cumsum(starts | (np.diff(us, prepend=us[0]) > gap_s * 1e6)) - 1   # segments of all vehicles
    segment = every - every[starts][owner]                                     # owners are numbered from 0, each has rows
    zone = _zones(sec, pid, anchors, every)
    opens = _changes(every, zone)                                              # zones are in the order of time
    part = np.cumsum(opens) - 1
    begin = np.flatnonzero(opens)
    first, last = sec[begin], sec[np.append(begin[1:], n) - 1]
    rounded = np.array([round(v, 1) for v in value.tolist()])
    near = np.rint(value)
    sensor, _ = pd.factorize(pid, use_na_sentinel=False)
    by = np.lexsort((np.arange(n), rounded, sensor, part))                     # NaN is last and one group
    r = rounded[by]
    fresh = _changes(part[by], sensor[by])
    fresh[1:] |= ~((r[1:] == r[:-1]) | (np.isnan(r[1:]) & np.isnan(r[:-1])))
    at = np.flatnonzero(fresh)
    end = np.append(at[1:], n) - 1
    head, tail, val = by[at], by[end], value[by]
    out = {"segment": segment[head], "zone": zone[head], "zone_first": first[part[head]], "zone_last": last[part[head]],
           "pid": pid[head], "rounded": rounded[head], "n": end - at + 1,
           "n_on": np.add.reduceat((val >= level).astype(np.int64), at), "total": np.add.reduceat(val, at),
           "lo": np.minimum.reduceat(val, at), "hi": np.maximum.reduceat(val, at), "first_us": us[head],
           "first_seq": seq[head], "last_us": us[tail], "last_seq": seq[tail], "first_value": value[head],
           "last_value": value[tail], "whole": np.logical_and.reduceat((near == value)[by], at),
           "int_lo": np.minimum.reduceat(near[by], at), "int_hi": np.maximum.reduceat(near[by], at), "unit": unit[tail]}
    mine = np.flatnonzero(pid == distance)
    opens = _changes(part[mine])
    lo = np.flatnonzero(opens)
    hi = np.append(lo[1:], len(mine))[:len(lo)]
    a, z, q = mine[lo], mine[hi - 1], part[mine[lo]]
    readings = value[mine].tolist()
    rows = {"segment": segment[a], "zone": zone[a], "zone_first": first[q], "zone_last": last[q], "pid": pid[a],
            "first_us": us[a], "first_seq": seq[a], "last_us": us[z], "last_seq": seq[z]}
    if vehicle is not None:
        out["vehicle_id"], rows["vehicle_id"] = vehicle[order][head], vehicle[order][a]
    made = {c: x.tolist() + (rows[c].tolist() if c in rows else [None] * len(a)) for c, x in out.items()}
    return made | {"readings": [None] * len(at) + [readings[i:j] for i, j in zip(lo.tolist(), hi.tolist())]}


class ChunkProcessor(StatefulProcessor):
    """State of one (bucket, chunk): its samples so far, one Arrow block per micro-batch; gone once a timer closes it."""

    def __init__(self, width_s: float, anchors: Sequence[str], gap_s: float, distance: str, level: float):
        self.width_s, self.how = width_s, (tuple(anchors), gap_s, distance, level)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("samples", "block binary")

    def _out(self, key: tuple, made: dict) -> pd.DataFrame:
        size = len(made["closed"])
        made = made | {"chunk": [key[1]] * size}
        return pd.DataFrame({c: pd.Series(made.get(c, [None] * size), dtype=object) for c in _NAMES})

    def _held(self) -> list[pa.Table]:
        return [pa.ipc.open_stream(b[0]).read_all() for b in self.blocks.get()] if self.blocks.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pa.concat_tables([pa.Table.from_pandas(r[list(_BLOCK.names)], _BLOCK, preserve_index=False) for r in rows])
        held = self._held()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _BLOCK) as writer:
            writer.write_table(fresh)
        if not held:
            self.handle.registerTimer(int((key[1] + 1) * self.width_s * 1000))
        self.blocks.appendList([(sink.getvalue().to_pybytes(),)])
        touched = fresh["vehicle"].unique()
        table = pa.concat_tables([*[h.filter(pc.is_in(h["vehicle"], touched)) for h in held], fresh])
        us, seq, pid, value, unit, vehicle = (table.column(c).to_numpy() for c in _BLOCK.names)
        made = summarise(us, seq, pid, value, unit, *self.how, vehicle=vehicle)
        yield self._out(key, made | {"closed": [False] * len(made["n"])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        vehicles = pa.concat_tables(self._held())["vehicle"].unique().to_pylist()
        self.blocks.clear()
        yield self._out(key, {"vehicle_id": vehicles, "closed": [True] * len(vehicles)})

    def close(self) -> None:
        pass


def bucket_count(rows: int) -> int:
    """Buckets for a stream of about ``rows`` samples, so that a state key stays the same size as the stream grows."""
    return max(1, -(-rows // BUCKET_ROWS))


def chunk_summaries(samples: DataFrame, width: str, delay: str, gap_s: float, anchors: Sequence[str] = fv.ENGINE_ANCHORS,
                    rules: dpf.DpfRules = dpf.DpfRules(), buckets: int = 16) -> DataFrame:
    """The stream of summaries of touched and closed chunks.

    ``samples`` is a stream of vehicle_id, ts (timestamp), seq, pid, value, unit.  A chunk is ``width`` of a
    vehicle's time; the samples of a bucket's chunk are the largest thing one task holds.  ``buckets`` (see ``bucket_count``)
    must stay the same for a checkpoint, as the number of shuffle partitions must.
    """
    spark = samples.sparkSession
    width_s = float(spark.range(1).select(F.expr(f"unix_micros(timestamp'1970-01-01' + INTERVAL {width}) "
                                                 "- unix_micros(timestamp'1970-01-01')")).first()[0]) / 1e6
    us = F.unix_micros("ts")
    rows = samples.select(F.pmod(F.xxhash64("vehicle_id"), F.lit(buckets)).cast("int").alias("bucket"),
                          F.col("vehicle_id").cast("string").alias("vehicle"), F.floor(us / F.lit(width_s * 1e6)).cast("long").alias("chunk"), "ts",
                          us.alias("us"), "seq", "pid", F.col("value").cast("double").alias("value"), "unit")
    vehicle = samples.schema["vehicle_id"].dataType.simpleString()
    processor = ChunkProcessor(width_s, anchors, gap_s, rules.sensors["distance"], rules.level)
    made = rows.withWatermark("ts", delay).groupBy("bucket", "chunk").transformWithStateInPandas(
        processor, SUMMARY.format(vehicle="string"), "update", "EventTime")
    return made.withColumn("vehicle_id", F.col("vehicle_id").cast(vehicle))


def store_summaries(stream: DataFrame, out: str, checkpoint: str):
    """Start storing the stream; a repeated micro-batch overwrites its own folder.

    Keyed processors need the RocksDB state store, which is set for this stream only.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, STATE_STORE)
    try:
        return stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest summary of every chunk, with whether a timer has closed it."""
    stored = spark.read.parquet(out)
    rows = stored.where(F.col("pid").isNotNull())
    newest = stored.groupBy(*_KEYS).agg(F.max(F.when(F.col("pid").isNotNull(), F.col("batch"))).alias("_newest"),
                                        F.bool_or("closed").alias("_closed"))
    return rows.join(newest, _KEYS).where(F.col("batch") == F.col("_newest")) \
        .withColumn("closed", F.col("_closed")).withColumn("first_at", F.struct("first_us", "first_seq")) \
        .withColumn("last_at", F.struct("last_us", "last_seq")) \
        .drop("batch", "_newest", "_closed", "first_us", "first_seq", "last_us", "last_seq")


def sessions(chunks: DataFrame, gap_s: float, delay_s: float, chunk_s: float) -> DataFrame:
    """(vehicle_id, chunk, segment, trip_id, session_start, session_end, closed) of every segment.

    Segments of a vehicle make one session as long as the pauses between them are at most ``gap_s``.  A session is closed once
    every sample the watermark still admits would open another.  ``trip_id`` is the vehicle and the start.
    """
    cuts = chunks.groupBy(*_KEYS, "segment").agg(F.min("zone_first").alias("t_first"), F.max("zone_last").alias("t_last"))
    late = chunks.agg(F.max("zone_last").alias("newest"))
    order, piece = ["t_first"], o.chunk_by_time("t_first", chunk_s)
    opened = o.ordered_scan(cuts, ["vehicle_id"], order, piece, _before=o.previous("t_last"))
    opens = F.when(F.col("t_first") - F.col("_before") > gap_s, 1).when(F.col("_before").isNull(), 1).otherwise(0)
    numbered = o.ordered_scan(opened.withColumn("_opens", opens), ["vehicle_id"], order, piece,
                              _number=o.running_sum("_opens"))
    whole = numbered.groupBy("vehicle_id", "_number").agg(F.min("t_first").alias("session_start"),
                                                          F.max("t_last").alias("session_end"))
    found = whole.join(F.broadcast(late)).withColumn(           # one row
        "closed", F.col("session_end") + gap_s + delay_s < F.col("newest"))
    name = F.concat_ws("@", F.col("vehicle_id").cast("string"), F.round(F.col("session_start") * 1e6).cast("long").cast("string"))
    return numbered.join(found, ["vehicle_id", "_number"]).select(
        *_KEYS, "segment", name.alias("trip_id"), "session_start", "session_end", "closed")


def windowed_groups(chunks: DataFrame, segments: DataFrame, anchors: Sequence[str] = fv.ENGINE_ANCHORS):
    """(all groups by session, those inside their session's engine window)."""
    rows = chunks.drop("closed").join(segments, [*_KEYS, "segment"])
    aggs = []
    for i, anchor in enumerate(anchors):
        mine = F.col("pid") == anchor
        aggs += [F.min(F.when(mine, F.col("first_at.first_us") / 1e6)).alias(f"lo{i}"),
                 F.max(F.when(mine, F.col("last_at.last_us") / 1e6)).alias(f"hi{i}")]
    bounds = rows.groupBy("trip_id").agg(F.min("zone_first").alias("lo"), F.max("zone_last").alias("hi"), *aggs)
    n = range(len(anchors))
    windows = bounds.select("trip_id", F.coalesce(*[F.col(f"lo{i}") for i in n], "lo").alias("t_start"),
                            F.coalesce(*[F.col(f"hi{i}") for i in n], "hi").alias("t_end"))
    inside = rows.join(windows, "trip_id").where((F.col("zone_first") >= F.col("t_start")) & (F.col("zone_last") <= F.col("t_end")))
    return rows, inside


def session_statistics(chunks: DataFrame, slugs: DataFrame, gap_s: float, delay_s: float, chunk_s: float,
                       anchors: Sequence[str] = fv.ENGINE_ANCHORS, rounded: bool = True) -> DataFrame:
    """The fourteen statistics per (session, slug): vehicle_id, trip_id, session_start, session_end, closed and those of ``pid_stats``."""
    segments = sessions(chunks, gap_s, delay_s, chunk_s)
    rows, inside = windowed_groups(chunks, segments, anchors)
    # the rows of readings have no unit, and the time of another row
    facts = rows.where("readings is null").groupBy("trip_id", "pid").agg(F.min("first_at").alias("first_seq"), F.max_by("unit", "last_at").alias("unit"))
    groups = inside.where("readings is null").groupBy("trip_id", "pid", "rounded").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min("first_at").alias("first_seq"), F.max("last_at").alias("last_seq"),
        F.min_by("first_value", "first_at").alias("first_value"), F.max_by("last_value", "last_at").alias("last_value"),
        (F.min("first_at")["first_us"] / 1e6).alias("first_sec"), (F.max("last_at")["last_us"] / 1e6).alias("last_sec"),
        F.bool_and("whole").alias("whole"), F.min("int_lo").alias("int_lo"), F.max("int_hi").alias("int_hi"),
        F.max("t_start").alias("t_start"), F.max("t_end").alias("t_end"))
    stats = ps.stats_of_groups(groups, facts, slugs, rounded)
    whole = segments.groupBy("trip_id").agg(F.first("vehicle_id").alias("vehicle_id"), F.first("session_start").alias("session_start"),
                                            F.first("session_end").alias("session_end"), F.first("closed").alias("closed"))
    return stats.join(whole, "trip_id")


def session_dpf_state(chunks: DataFrame, gap_s: float, delay_s: float, chunk_s: float,
                      anchors: Sequence[str] = fv.ENGINE_ANCHORS, rules: dpf.DpfRules = dpf.DpfRules()) -> DataFrame:
    """The filter state per session, as ``dpf.dpf_state`` gives it per trip, with session_start, session_end and closed."""
    segments = sessions(chunks, gap_s, delay_s, chunk_s)
    _, inside = windowed_groups(chunks, segments, anchors)
    s = rules.sensors
    rows = inside.where(F.col("readings").isNull() & F.col("pid").isin(*sorted(set(s.values()))))

    def only(role, c):
        return F.when(F.col("pid") == s[role], F.col(c))

    features = rows.groupBy("trip_id").agg(
        F.coalesce(F.sum(only("status", "n_on")), F.lit(0)).alias("requests"), F.max(only("enable", "hi")).alias("enable_max"),
        F.max(only("egt_after", "hi")).alias("egt_max"), F.max(only("nox_cat", "hi")).alias("nox_max"),
        F.max(only("inlet", "hi")).alias("inlet_max"), F.max(only("outlet", "hi")).alias("outlet_max"),
        F.max_by(only("soot", "last_value"), only("soot", "last_at")).alias("soot_last"),
        F.min_by(only("distance", "first_value"), only("distance", "first_at")).alias("dist_first"),
        F.max_by(only("distance", "last_value"), only("distance", "last_at")).alias("dist_last"),
        F.min(only("distance", "first_at")).alias("dist_first_at"),
        F.coalesce(F.sum(only("distance", "n")), F.lit(0)).alias("dist_n"))
    pieces = inside.where("readings is not null").select(
        "trip_id", F.col("first_at").alias("order"), F.col("first_at"), "readings")
    made = dpf.state_of(features, pieces, rules)
    whole = segments.groupBy("trip_id").agg(F.first("vehicle_id").alias("vehicle_id"), F.first("session_start").alias("session_start"),
                                            F.first("session_end").alias("session_end"), F.first("closed").alias("closed"))
    return made.join(whole, "trip_id")
