"""Two-level ordered scans against plain windows, with chunks far smaller than the groups."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tripweave.operators import dpf, ordered as o, pid_stats as ps, samples as sm, trip_fields as tf


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(11)
    data = [(g, i, rnd.choice([None, round(rnd.uniform(0, 9), 1)]))
            for g, n in (("hot", 600), ("b", 40), ("c", 1)) for i in sorted(rnd.sample(range(3000), n))]
    return spark.createDataFrame(data, "g string, seq long, v double").cache()


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_scan_equals_window(rows, size):
    got = o.ordered_scan(rows, ["g"], ["seq"], o.chunk_by_sequence("seq", size), p=o.previous("v"),
                         n=o.following("v"), last=o.latest("v"), nxt=o.upcoming("v"), top=o.max_before("v"),
                         acc=o.running_sum(F.lit(2)), pos=o.position(), size=o.group_size())
    w = Window.partitionBy("g").orderBy("seq")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = rows.select(
        "*", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"),
        F.last("v", True).over(back).alias("last"), F.first("v", True).over(ahead).alias("nxt"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("top"),
        F.sum(F.lit(2)).over(back).alias("acc"), F.row_number().over(w).cast("bigint").alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy("g")).alias("size"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def series(spark, values, pid="p", trip=1, start=0):
    data = [(trip, start + i, float(i), pid, float(x), "u", 0.0, 0.0) for i, x in enumerate(values)]
    return spark.createDataFrame(data, "trip_id long, seq long, sec double, pid string, value double, "
                                       "unit string, lat double, lon double")


def test_runs_cross_chunks(spark):
    rnd = random.Random(2)
    values = [rnd.choice([1, 9, 1, 1]) for _ in range(300)]
    best = run = 0
    for x in values:
        run = run + 1 if x < 5 else 0
        best = max(best, run)
    for size in (1, 4, 1000):
        got = dpf.run_length_below(series(spark, values), ["trip_id"], F.lit(5.0), size).collect()
        assert [r.longest_run for r in got] == [best]


def test_downsample_equals_index_formula(spark):
    rnd = random.Random(4)
    for n in (1, 59, 60, 61, 118, 119, 237, 1000):
        values = [rnd.random() for _ in range(n)]
        want = values if n <= 60 else [values[round(i * ((n - 1) / 59))] for i in range(60)]
        got = ps.downsample(series(spark, values), 60, chunk_rows=50).orderBy("point").collect()
        assert [r.value for r in got] == want
        assert got[0].value == values[0] and got[-1].value == values[-1]


def test_integral_is_chunk_independent(spark):
    rnd = random.Random(6)
    values = [rnd.uniform(0, 50) for _ in range(200)]
    want = sum((values[i] + values[i - 1]) / 2 / 3600 for i in range(1, 200))
    for size in (1, 13, 500):
        rows = series(spark, values).withColumn("chunk", o.chunk_by_sequence("seq", size))
        got = tf.integrate(rows, ["p"]).collect()[0]
        assert abs(got.integral - want) < 1e-9 and got.samples == 200
    one = series(spark, [5.0]).withColumn("chunk", F.lit(0))
    assert tf.integrate(one, ["p"]).collect()[0].integral is None


def test_hot_trip_window_and_track(spark):
    rnd = random.Random(8)
    data = [(1, i, float(i), "rpm" if 20 <= i <= 180 else "x", 1.0, "", float(rnd.randrange(3)), 1.0)
            for i in range(200)]
    rows = spark.createDataFrame(data, "trip_id long, seq long, sec double, pid string, value double, "
                                       "unit string, lat double, lon double")
    windows, clipped = sm.windowed_samples(rows, ["none", "rpm"], chunk_rows=8)
    w = windows.collect()[0]
    assert (w.t_start, w.t_end, w.anchor) == (20.0, 180.0, "rpm")
    kept, prev = [], None
    for _, _, sec, _, _, _, lat, lon in data:
        if 20 <= sec <= 180 and (lat, lon) != prev:
            kept.append(sec)
            prev = (lat, lon)
    track = sm.tracks(sm.gps_fixes(clipped), chunk_rows=8).orderBy("idx").collect()
    assert [r.sec for r in track] == kept and [r.idx for r in track] == list(range(len(kept)))
