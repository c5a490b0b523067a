"""Tables the library keeps: incremental ingest, upsert, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave.operators import ordered as o
from tripweave.operators.durable import materialize


def ingest_incremental(incoming: DataFrame, existing: DataFrame, key: str = "trip_id") -> DataFrame:
    """Rows whose key is not stored yet."""
    return incoming.join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "trip_id",
           version: str = "version") -> DataFrame:
    """Newest row per key over both tables.

    ``max_by`` keeps one row per key and task before the exchange, so many
    versions of one key never meet in one place.
    """
    both = existing.unionByName(incoming, allowMissingColumns=True)
    row = F.struct(*both.columns)
    order = F.struct(F.col(version), *[F.col(c) for c in both.columns if c not in (key, version)
                                       and _orderable(both, c)])
    return both.groupBy(key).agg(F.max_by(row, order).alias("_r")).select("_r.*")


def _orderable(df: DataFrame, c: str) -> bool:
    return "map<" not in dict(df.dtypes)[c]


def write_samples(samples: DataFrame, table: str, buckets: int = 256, chunk_rows: int = o.CHUNK_ROWS,
                  mode: str = "append", path: str | None = None) -> None:
    """Store samples bucketed by (trip, chunk) and sorted by (trip, order).

    Window joins then read matching buckets without a shuffle, a hot trip is
    spread over its chunks, and the sensor filter prunes row groups.
    """
    writer = (samples.withColumn("chunk", o.chunk_by_sequence("seq", chunk_rows))
              .write.mode(mode).format("parquet").bucketBy(buckets, "trip_id", "chunk")
              .sortBy("trip_id", "pid", "seq"))
    (writer.option("path", path) if path else writer).saveAsTable(table)


def _in_buckets(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _replace_buckets(rows: DataFrame, path: str) -> None:
    (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))


def write_keyed(rows: DataFrame, path: str, key: str = "trip_id", buckets: int = 64, version: str = "version") -> None:
    """Store the newest row per key in folders by a hash of the key.

    A key never changes its folder, whatever else about the row changes, so replacing
    a folder leaves nothing stale behind.
    """
    _replace_buckets(_in_buckets(upsert(rows.limit(0), rows, key, version), key, buckets), path)


def upsert_keyed(spark: SparkSession, path: str, incoming: DataFrame, key: str = "trip_id", buckets: int = 64,
                 version: str = "version") -> None:
    """Merge rows into a stored table; only the folders their keys fall into are read and rewritten."""
    incoming = materialize(_in_buckets(incoming, key, buckets), "incoming")
    touched = [r.bucket for r in incoming.select("bucket").distinct().collect()]     # at most ``buckets`` numbers
    stored = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    merged = materialize(upsert(stored, incoming, key, version), "merged")
    _replace_buckets(merged, path)


def write_trips(trips: DataFrame, path: str) -> None:
    """Store a whole table of trips by start date; for later changes use ``write_keyed``."""
    (trips.withColumn("start_date", F.to_date("start"))
     .write.mode("overwrite").partitionBy("start_date").parquet(path))


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def tracks_table(trips: DataFrame) -> DataFrame:
    """(trip_id, track) of trips that have one; only these two columns are read."""
    return trips.select("trip_id", "track").filter(F.size("track") > 0)
