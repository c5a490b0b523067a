"""Ranges much longer than the bucket: rows and exchanges stay few, results the same."""

import random

import pytest
from pyspark.sql import functions as F
from test_decisions import legs_of, trips_of
from test_plans import exchanges, static  # noqa: F401

from tripweave.operators import reconcile as rc
from tripweave.plans import QUERIES
from tripweave.streaming import reconciling as rg

FOLDER = "/root/testdata/sf0.001"
LONG = 10_000_000


def test_long_recordings_take_few_buckets(spark):
    """With buckets of 1 ms each of these would be in more of them than an array can name."""
    rows = [("v", k, k * 1000, k * 1000 + LONG, 1, 1.0, 1.0) for k in range(5)]
    assert rc.overlap_pairs(trips_of(spark, rows), 1e-3).count() == 10
    got = rc.leg_session_join(legs_of(spark, [("v", 7, LONG // 2, 5.0, 1.0)]), trips_of(spark, rows), bucket_s=1e-3).collect()
    assert [(r.leg_id, r.trip_id) for r in got] == [(7, 4)]


def test_placed_legs_are_all_legs(spark):
    rnd = random.Random(5)
    trips = [(f"v{k % 3}", k, (s := rnd.randrange(100_000)), s + rnd.choice((10, 900, 20_000)), 1, 1.0, 1.0) for k in range(60)]
    legs = [(f"v{k % 4}", k, rnd.randrange(120_000), 5.0, 1.0) for k in range(300)]
    rows = legs_of(spark, legs).withColumn("start", F.when(F.col("leg_id") % 9 != 0, F.col("start")))
    got = {r.leg_id: r.trip_id for r in rc.place_legs(rows, trips_of(spark, trips)).collect()}

    def best(v, k, t):
        inside = [(-s, i) for w, i, s, e, *_ in trips if w == v and k % 9 and s - 360 <= t <= e + 360]
        return min(inside)[1] if inside else None

    assert got == {k: best(v, k, t) for v, k, t, *_ in legs}


@pytest.mark.parametrize("name,most", [("overlap_self_join", 5), ("leg_aggregate", 6), ("enrich_update", 9), ("unmatched_union", 4), ("tracks_concat", 11)])
def test_exchanges_of_legs_and_trips(static, name, most):  # noqa: F811
    assert exchanges(QUERIES[name](static, FOLDER)) <= most


def test_newest_rows_are_chosen_where_they_lie(static, tmp_path):  # noqa: F811
    rows = static.createDataFrame([(1, 10, 2.0, False), (2, 20, 3.0, True)], "vehicle_id long, trip_id long, km double, gone boolean")
    rows.write.parquet(f"{tmp_path}/batch=0")
    got = rg.arrived(static, str(tmp_path), rows.schema, "trip_id", 0, rows.select("vehicle_id"))
    assert [tuple(r) for r in got.collect()] == [(1, 10, 2.0)] and exchanges(got) <= 2
