"""Events of derived trips: new, changed, vanished, and none when a batch is repeated."""

import tempfile

from pyspark.sql import functions as F

from tripweave.streaming import push

SCHEMA = "trip_id long, value double"


def derive(samples):
    """A trip is gone while its samples add up to nothing."""
    return samples.groupBy("trip_id").agg(F.sum("value").alias("total"), F.max("value").alias("high")).where("total <> 0")


def test_events_of_batches_and_of_repeated_batches(spark):
    inbox, path, mark = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(3))
    path += "/push"
    batches = [[(1, 5.0), (2, 1.0)], [(2, 0.0), (3, 4.0)], [(1, -5.0), (2, 3.0)], [(1, 2.0), (3, 0.0)]]
    want = [{(1, "inserted", 5.0), (2, "inserted", 1.0)}, {(3, "inserted", 4.0)}, {(1, "removed", None), (2, "updated", 4.0)},
            {(1, "inserted", 2.0)}]

    def stream(checkpoint):
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
        push.push_trips(rows, derive, path, checkpoint).awaitTermination()

    def seen():
        got = [set() for _ in batches]
        for r in push.events(spark, path).collect():
            got[r.batch].add((r.trip_id, r.change, r.total))
        return got

    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        stream(mark)
    assert seen() == want
    stream(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))              # all batches again, as after a lost checkpoint
    assert seen() == want


def test_equal_rows_are_no_change(spark):
    rows = spark.createDataFrame([(1, 2.0, None), (2, None, "x"), (None, 1.0, "y")], "trip_id long, a double, b string")
    before = push._digest(rows, "trip_id").select("trip_id", "_digest")
    assert push.changes(before.where("trip_id is not null"), rows, "trip_id").count() == 0
    moved = rows.withColumn("b", F.when(F.col("trip_id") == 1, "z").otherwise(F.col("b")))
    assert [(r.trip_id, r.change) for r in push.changes(before.where("trip_id is not null"), moved, "trip_id").collect()] == [(1, "updated")]
