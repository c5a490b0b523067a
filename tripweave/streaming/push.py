"""Pushing trips as they are derived: one event per new, changed or vanished trip, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T


def _digest(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a digest of all columns but the key; two versions of a trip are equal if it is."""
    rest = sorted(c for c in rows.columns if c != key)
    text = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("")
    return rows.withColumn("_digest", F.sha2(text, 256))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``after`` with the column ``change``: inserted or updated; keys only ``before`` has come as removed, their columns null.

    ``before`` is (key, _digest).  Unchanged trips give no row; a null key is no trip.
    """
    new = _digest(after.where(F.col(key).isNotNull()), key)
    old = before.select(F.col(key).alias("_old"), F.col("_digest").alias("_was"))
    both = new.join(old, new[key] == old["_old"], "full_outer")
    change = (F.when(F.col("_was").isNull(), "inserted").when(F.col("_digest").isNull(), "removed")
              .when(F.col("_digest") != F.col("_was"), "updated"))
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select(
        F.coalesce(key, "_old").alias(key), *[c for c in after.columns if c != key], "change", "_digest")


def push_trips(samples: DataFrame, derive: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "trip_id",
               once: bool = True):
    """Start the stream: every micro-batch stores its samples, derives its trips anew and stores what changed.

    ``path`` gets three tables by micro-batch: ``samples``, ``versions`` (key and digest of every trip it changed) and ``events``.
    A batch only reads earlier batches of the others and overwrites its own folders, so a repeated batch gives the same events
    and no consumer sees one twice.  Only the trips a batch has samples of are derived; ``derive`` gets all of their samples.
    """
    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = f"{path}/samples/batch={number}"
        batch.write.mode("overwrite").parquet(mine)
        fields = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
        so_far = spark.read.schema(fields).option("basePath", f"{path}/samples").parquet(f"{path}/samples") \
            .where(F.col("batch") <= number).drop("batch")
        touched = spark.read.schema(batch.schema).parquet(mine).select(key).distinct()
        trips = derive(so_far.join(touched, key, "left_semi"))
        kind = batch.schema[key].dataType.simpleString()
        if number:
            versions = spark.read.schema(f"{key} {kind}, _digest string, batch long").parquet(f"{path}/versions")
            known = versions.where(F.col("batch") < number).groupBy(key).agg(F.max_by("_digest", "batch").alias("_digest"))
            before = known.where(F.col("_digest").isNotNull()).join(touched, key, "left_semi")
        else:
            before = spark.createDataFrame([], f"{key} {kind}, _digest string")
        events = f"{path}/events/batch={number}"
        changes(before, trips, key).write.mode("overwrite").parquet(events)
        spark.read.parquet(events).select(key, "_digest").write.mode("overwrite").parquet(f"{path}/versions/batch={number}")

    writer = samples.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def events(spark, path: str) -> DataFrame:
    """All events so far, with the micro-batch that pushed them."""
    return spark.read.parquet(f"{path}/events").drop("_digest")
