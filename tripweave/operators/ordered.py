"""Ordered computations that never gather a whole group in one task.

A plain window partitioned by trip would sort every row of a trip in one task,
and one trip may hold a third of all rows.  ``ordered_scan`` therefore works in
two levels: rows are windowed inside (group, chunk), where ``chunk`` cuts the
order into bounded pieces, and one summary row per chunk carries the state
across the cuts.  The raw rows are exchanged once, on (group, chunk); the
summary is built by a partial aggregation and is smaller by the chunk length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tripweave.operators.durable import CODEC, new_folder, remove

CHUNK_ROWS = 65_536
_CHUNK = "_chunk"
#: the column in which rows that were laid out already say their chunk
LAID = "chunk"


def chunk_by_sequence(seq: str = "seq", rows: int = CHUNK_ROWS) -> Column:
    """Chunk of a unique integer order: at most ``rows`` rows per group and chunk."""
    return F.expr(f"{seq} div {rows}")


def chunk_by_time(seconds: Column | str, width: float) -> Column:
    """Chunk of a time order: at most the rows of ``width`` seconds per group."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.floor(c / F.lit(float(width))).cast("bigint")


def equi_depth(rows: DataFrame, order: Sequence[str], chunk_rows: int = CHUNK_ROWS, stored: bool = False) -> DataFrame:
    """Rows stored by ranges of ``order`` (keys first, unique), about ``chunk_rows`` in each; ``chunk`` is the range.

    The number of ranges comes from the number of rows, so a chunk stays the same size whatever the keys, times or nulls
    are: one hot key, or rows without a time, spread over as many chunks as they fill.  ``stored`` says that the rows are
    columns of a stored table, which need not be written before they are counted and sampled.
    """
    spark, raw, path = rows.sparkSession, new_folder(rows.sparkSession, "rows"), new_folder(rows.sparkSession, "ranges")
    whole = rows
    if not stored:
        rows.write.option("compression", CODEC).parquet(raw)                          # counted, sampled and laid out, so computed once
        whole = spark.read.schema(rows.schema).parquet(raw)
    n = max(1, -(-whole.count() // chunk_rows))
    if n == 1:
        return whole.withColumn(LAID, F.lit(0))
    whole.repartitionByRange(n, *order).withColumn(LAID, F.spark_partition_id()).write.option("compression", CODEC) \
        .partitionBy(LAID).parquet(path)
    if not stored:
        remove(spark, raw)
    return spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(LAID, T.IntegerType())])).parquet(path)


@dataclass(frozen=True)
class Step:
    """One output of an ordered scan."""

    local: Callable                       # (rows window, order) -> expression inside the chunk
    summary: Callable                     # order key -> {suffix: aggregate per chunk}
    carried: Callable                     # (name, chunk windows) -> expression per chunk
    merge: Callable                       # (local, carried, position in chunk, size) -> result
    flags: dict = field(default_factory=dict)


def _windows(keys: Sequence[str], order: Sequence[str]):
    base = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    chunks = Window.partitionBy(*keys).orderBy(_CHUNK)
    return base, chunks


def previous(c: Column | str) -> Step:
    """Value of the previous row (``lag``)."""
    c = F.col(c) if isinstance(c, str) else c
    return Step(
        local=lambda w: F.lag(c).over(w),
        summary=lambda o: {"v": F.max_by(c, o)},
        carried=lambda n, w: F.lag(F.col(f"{n}_v")).over(w),
        merge=lambda loc, car, first, last: F.when(first, car).otherwise(loc))


def following(c: Column | str) -> Step:
    """Value of the next row (``lead``)."""
    c = F.col(c) if isinstance(c, str) else c
    return Step(
        local=lambda w: F.lead(c).over(w),
        summary=lambda o: {"v": F.min_by(c, o)},
        carried=lambda n, w: F.lead(F.col(f"{n}_v")).over(w),
        merge=lambda loc, car, first, last: F.when(last, car).otherwise(loc))


def latest(c: Column | str) -> Step:
    """Last non-null value up to and including this row."""
    c = F.col(c) if isinstance(c, str) else c
    return Step(
        local=lambda w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        summary=lambda o: {"v": F.max_by(c, F.when(c.isNotNull(), o))},
        carried=lambda n, w: F.last(F.col(f"{n}_v"), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)),
        merge=lambda loc, car, first, last: F.coalesce(loc, car))


def upcoming(c: Column | str) -> Step:
    """First non-null value from this row on."""
    c = F.col(c) if isinstance(c, str) else c
    return Step(
        local=lambda w: F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        summary=lambda o: {"v": F.min_by(c, F.when(c.isNotNull(), o))},
        carried=lambda n, w: F.first(F.col(f"{n}_v"), ignorenulls=True).over(
            w.rowsBetween(1, Window.unboundedFollowing)),
        merge=lambda loc, car, first, last: F.coalesce(loc, car))


def max_before(c: Column | str) -> Step:
    """Largest value of all earlier rows."""
    c = F.col(c) if isinstance(c, str) else c
    return Step(
        local=lambda w: F.max(c).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        summary=lambda o: {"v": F.max(c)},
        carried=lambda n, w: F.max(F.col(f"{n}_v")).over(
            w.rowsBetween(Window.unboundedPreceding, -1)),
        merge=lambda loc, car, first, last: F.greatest(loc, car))


def running_sum(c: Column | str) -> Step:
    """Sum up to and including this row."""
    c = F.col(c) if isinstance(c, str) else c
    return Step(
        local=lambda w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        summary=lambda o: {"v": F.sum(c)},
        carried=lambda n, w: F.sum(F.col(f"{n}_v")).over(
            w.rowsBetween(Window.unboundedPreceding, -1)),
        merge=lambda loc, car, first, last: F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0)))


def position() -> Step:
    """1-based position of the row in its group."""
    return Step(
        local=lambda w: F.row_number().over(w),
        summary=lambda o: {"v": F.count(F.lit(1))},
        carried=lambda n, w: F.sum(F.col(f"{n}_v")).over(
            w.rowsBetween(Window.unboundedPreceding, -1)),
        merge=lambda loc, car, first, last: loc + F.coalesce(car, F.lit(0)))


def group_size() -> Step:
    """Number of rows of the whole group."""
    return Step(
        local=lambda w: F.lit(None).cast("bigint"),
        summary=lambda o: {"v": F.count(F.lit(1))},
        carried=lambda n, w: F.sum(F.col(f"{n}_v")).over(
            w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        merge=lambda loc, car, first, last: car)


def _laid_out(df: DataFrame, keys: list[str], chunk: Column | None) -> DataFrame:
    """df with its chunk, its rows together by (keys, chunk): everything after this shares the one exchange of rows."""
    if chunk is None:
        return df.withColumn(_CHUNK, F.col(LAID))
    return df.withColumn(_CHUNK, chunk).repartition(*keys, _CHUNK)


def chunk_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None,
               local: Sequence[dict], summary: dict, carried: Sequence[dict], out: dict) -> DataFrame:
    """Columns that depend on each other over the whole order, with one exchange of the rows.

    ``local`` are stages of expressions of the window inside a chunk, each of which may use the ones before;
    ``_first`` says whether a row is its chunk's first.  ``summary`` aggregates a chunk.  ``carried`` are stages over a
    group's chunks, which see the summaries in order.  ``out`` combines both.  ``chunk`` None takes the column ``chunk``
    of rows that are hashed by (keys, chunk) already.
    """
    keys, order, names = list(keys), list(order), df.columns
    rows_w, chunk_w = _windows(keys, order)
    rows = _laid_out(df, keys, chunk).withColumn("_first", F.row_number().over(rows_w) == 1)
    for stage in local:
        rows = rows.select("*", *[make(rows_w).alias(n) for n, make in stage.items()])
    chunks = rows.groupBy(*keys, _CHUNK).agg(*[c.alias(n) for n, c in summary.items()])
    for stage in carried:
        chunks = chunks.select("*", *[make(chunk_w).alias(n) for n, make in stage.items()])
    return rows.join(chunks, [*keys, _CHUNK]).select(*names, *[c.alias(n) for n, c in out.items()])


def first_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None,
                 **steps: Step) -> DataFrame:
    """Add one column per step, exact over the whole group.

    ``order`` must be unique inside a group and ``chunk`` non-decreasing in it; keys must not be null.  ``chunk`` None takes
    the column ``chunk`` of rows that are hashed by (keys, chunk) already.
    """
    keys, order = list(keys), list(order)
    kept = df.columns
    rows_w, chunk_w = _windows(keys, order)
    df = _laid_out(df, keys, chunk)
    key = first_key(order)

    aggs, carried = [], []
    for name, step in steps.items():
        for suffix, agg in step.summary(key).items():
            aggs.append(agg.alias(f"_{name}_{suffix}"))
        carried.append(step.carried(f"_{name}", chunk_w).alias(f"_{name}_in"))
    summary = df.groupBy(*keys, _CHUNK).agg(*aggs).select(*keys, _CHUNK, *carried)

    local = df.select(
        "*", *[s.local(rows_w).alias(f"_{n}_here") for n, s in steps.items()],
        (F.row_number().over(rows_w) == 1).alias("_is_first"),
        F.lead(F.lit(1)).over(rows_w).isNull().alias("_is_last"))
    joined = local.join(summary, [*keys, _CHUNK])
    outs = [s.merge(F.col(f"_{n}_here"), F.col(f"_{n}_in"), F.col("_is_first"),
                    F.col("_is_last")).alias(n) for n, s in steps.items()]
    return joined.select(*kept, *outs)
