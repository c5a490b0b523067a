"""Data-quality checks over the trip table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tripweave.functions import (add_seconds, dst_seconds, seconds_between, start_of_trip_id,
                                 trip_id_of_file)


def non_finite_audit(trips: DataFrame) -> DataFrame:
    """Per double column: rows that are NaN or infinite (one pass, then unpivoted)."""
    doubles = [f.name for f in trips.schema.fields if isinstance(f.dataType, T.DoubleType)]
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    counts = trips.agg(*[F.count_if(bad(c)).alias(c) for c in doubles])
    return counts.unpivot([], doubles, "field", "bad_rows")


def non_finite_values(rows: DataFrame, key: str = "trip_id") -> DataFrame:
    """(key, path, value): every NaN and infinity with its place, inside structs, lists and maps too.

    Paths read ``column.field``, ``column[index]`` and ``column[key]``; a map key that is no finite number has ``column{}``.
    The walk follows the schema, so columns that can't hold one are not read; one row in gives no more rows than it has such values.
    """
    found = [walked for f in rows.schema.fields if f.name != key
             and (walked := _walk(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name))) is not None]
    if not found:
        return rows.select(key, F.lit("").alias("path"), F.lit("").alias("value")).where("false")
    return rows.select(key, F.explode(F.concat(*found)).alias("_bad")).select(key, "_bad.path", "_bad.value")


def _walk(c: Column, kind: T.DataType, path: Column) -> Column | None:
    """The bad values of a column as an array of (path, value); None if its type has no room for one."""
    none = F.expr("cast(array() as array<struct<path:string,value:string>>)")

    def joined(parts: list) -> Column | None:
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None

    if isinstance(kind, (T.DoubleType, T.FloatType)):
        name = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity")
        return F.when(name.isNotNull(), F.array(F.struct(path.alias("path"), name.alias("value")))).otherwise(none)
    if isinstance(kind, T.StructType):
        return joined([_walk(c.getField(f.name), f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        if _walk(c, kind.elementType, path) is None:
            return None
        inner = F.transform(c, lambda x, i: _walk(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(inner), none)
    if isinstance(kind, T.MapType):
        def entry(e: Column) -> Column | None:
            place = F.concat(path, F.lit("["), e["key"].cast("string"), F.lit("]"))
            return joined([_walk(e["key"], kind.keyType, F.concat(path, F.lit("{}"))), _walk(e["value"], kind.valueType, place)])

        if _walk(c, kind.keyType, path) is None and _walk(c, kind.valueType, path) is None:
            return None
        return F.coalesce(F.flatten(F.transform(F.map_entries(c), entry)), none)
    return None


def start_drift_audit(trips: DataFrame, minimum_s: float = 60.0) -> DataFrame:
    """Trips whose id and stored start disagree; start and end moved by the difference."""
    right = start_of_trip_id("trip_id")
    drift = seconds_between("start", right)
    return (trips.withColumn("drift_s", drift).filter(F.abs("drift_s") >= minimum_s)
            .withColumn("start", right).withColumn("end", add_seconds("end", F.col("drift_s"))))


def shift_dst(legs: DataFrame) -> DataFrame:
    """Standalone legs moved back by the daylight-saving part of their start."""
    off = dst_seconds("start")
    return (legs.withColumn("_off", -off).withColumn("start", add_seconds("start", F.col("_off")))
            .withColumn("end", add_seconds("end", F.col("_off"))).drop("_off"))


def duplicate_files(files: DataFrame, name: str = "filename") -> DataFrame:
    """File names mapped to trip ids, one file kept per trip id (first by name)."""
    ids = files.select(trip_id_of_file(name).alias("trip_id"), F.col(name).alias("filename"))
    return ids.groupBy("trip_id").agg(F.min("filename").alias("filename"),
                                      F.count(F.lit(1)).alias("copies"))
