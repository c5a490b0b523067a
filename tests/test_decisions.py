"""Order-dependent decisions against straightforward Python, and their boundary cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripweave.operators import reconcile as rc
from tripweave.operators.ordered import equi_depth

T0 = datetime(2026, 1, 10, 8, 0, 0)
TRIP = ("vehicle_id string, trip_id long, start timestamp_ntz, end timestamp_ntz, pid_count long, "
        "duration_min double, distance_km double")
LEG = "vehicle_id string, leg_id long, start timestamp_ntz, distance_km double, duration_min double"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def trips_of(spark, rows):
    """rows: (vehicle, id, start s, end s or None, sensors, minutes, km)"""
    return spark.createDataFrame([(v, i, at(s), None if e is None else at(e), n, m, k)
                                  for v, i, s, e, n, m, k in rows], TRIP)


def legs_of(spark, rows):
    """rows: (vehicle, id, start s, km, minutes)"""
    return spark.createDataFrame([(v, i, at(s), k, m) for v, i, s, k, m in rows], LEG)


def losers(rows):
    """Pairwise elimination over recordings sorted by start."""
    rows, gone, out = sorted(rows, key=lambda r: (r[2], r[1])), set(), {}
    for i, a in enumerate(rows):
        if a[1] in gone or a[3] is None:
            continue
        for b in rows[i + 1:]:
            if b[1] in gone:
                continue
            if b[2] >= a[3]:
                break
            if (b[4], b[5]) > (a[4], a[5]):
                gone.add(a[1])
                out[a[1]] = b[1]
                break
            gone.add(b[1])
            out[b[1]] = a[1]
    return out


def test_overlaps_random(spark):
    rnd = random.Random(21)
    rows, want = [], {}
    for v in range(12):
        mine = []
        for k in range(rnd.choice([1, 2, 3, 60])):
            s = rnd.randrange(40_000)
            e = None if rnd.random() < 0.1 else s + rnd.randrange(1, 4000)
            mine.append((f"v{v}", v * 1000 + k, s, e, rnd.randrange(4), float(rnd.randrange(3)), 5.0))
        rows += mine
        want.update(losers(mine))
    for segment_rows in (7, 10**6):
        got = rc.overlap_dedup(trips_of(spark, rows), segment_rows).collect()
        assert {r.trip_id: r.winner_id for r in got} == want


def test_one_island_over_many_segments(spark):
    """A recording that covers all others reaches through every segment; then a richer one in the middle wins."""
    rows = [("v", 0, 0, 100_000, 5, 1.0, 5.0)] + [("v", k, 10 * k, 10 * k + 5, 1, 1.0, 5.0) for k in range(1, 100)]
    assert {r.trip_id: r.winner_id for r in rc.overlap_dedup(trips_of(spark, rows), 8).collect()} == losers(rows) \
        == {k: 0 for k in range(1, 100)}
    rows[50] = ("v", 50, 500, 100_000, 9, 1.0, 5.0)
    assert {r.trip_id: r.winner_id for r in rc.overlap_dedup(trips_of(spark, rows), 8).collect()} == losers(rows)


def test_segments_are_of_one_size_on_one_hot_vehicle(spark):
    rows = [("v", k, (k * 7919) % 3000, None, 1, 1.0, 5.0) for k in range(2000)]
    laid = equi_depth(trips_of(spark, rows).select("vehicle_id", "start", "trip_id"), ["vehicle_id", "start", "trip_id"], 100)
    sizes = [r["count"] for r in laid.groupBy("chunk").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 18 and max(sizes) <= 200


def test_no_rows_make_no_decisions(spark):
    assert rc.overlap_dedup(trips_of(spark, [])).collect() == [] and rc.leg_dedup(legs_of(spark, [])).collect() == []


def test_overlap_pairs_random(spark):
    rnd = random.Random(22)
    rows = [("v", k, (s := rnd.randrange(20_000)), s + rnd.randrange(1, 3000), 1, 1.0, 1.0) for k in range(80)]
    ranked = sorted(rows, key=lambda r: (r[2], r[1]))
    want = {(a[1], b[1]) for i, a in enumerate(ranked) for b in ranked[i + 1:] if b[2] < a[3]}
    got = {(r.trip_a, r.trip_b) for r in rc.overlap_pairs(trips_of(spark, rows), 700.0).collect()}
    assert got == want


@pytest.mark.parametrize("gap,joined", [(-1, False), (0, True), (300, True), (301, False)])
def test_chain_gap_boundaries(spark, gap, joined):
    rows = [("v", 1, 0, 100, 1, 1.0, 5.0), ("v", 2, 100 + gap, 900, 1, 1.0, 5.0)]
    got = {r.trip_id: r.primary_id for r in rc.sensor_chains(trips_of(spark, rows)).collect()}
    assert got == ({1: 1, 2: 1} if joined else {1: 1, 2: 2})


def test_merge_keeps_totals_and_primary_fields(spark):
    rows = trips_of(spark, [("v", 1, 0, 100, 9, 2.0, 4.0), ("v", 2, 150, 400, 3, 3.0, 6.0), ("v", 3, 9000, 9100, 1, 1.0, 1.0)])
    rows = (rows.withColumn("fuel_l", F.lit(0.5)).withColumn("max_speed_kmh", F.col("trip_id") * 10.0)
            .withColumn("avg_speed_kmh", F.lit(1.0)).withColumn("l100km", F.lit(1.0))
            .withColumn("alerts", F.array(F.col("trip_id").cast("int"), F.lit(7))))
    out = {r.trip_id: r for r in rc.merge_trips(rows, rc.sensor_chains(rows), nested_ids=True).collect()}
    m = out[1]
    assert set(out) == {1, 3} and m.merged_ids == [1, 2] and m.pid_count == 9
    assert (m.duration_min, m.distance_km, m.fuel_l, m.max_speed_kmh) == (5.0, 10.0, 1.0, 20.0)
    assert m.end == at(400) and m.alerts == [1, 2, 7] and m.l100km == 10.0 and abs(m.avg_speed_kmh - 120) < 1e-9
    assert out[3].l100km == 1.0


@pytest.mark.parametrize("start,inside", [(-361, False), (-360, True), (1360, True), (1361, False)])
def test_leg_in_session_boundaries(spark, start, inside):
    got = rc.leg_session_join(legs_of(spark, [("v", 1, start, 5.0, 1.0)]),
                              trips_of(spark, [("v", 9, 0, 1000, 1, 1.0, 5.0)])).collect()
    assert bool(got) == inside


def test_leg_one_hour_ahead_in_summer_and_latest_session(spark):
    summer = datetime(2026, 7, 1, 10, 0, 0)
    sessions = spark.createDataFrame([("v", i, summer + timedelta(minutes=m), summer + timedelta(minutes=m + 30))
                                      for i, m in ((1, 0), (2, 20))],
                                     "vehicle_id string, trip_id long, start timestamp_ntz, end timestamp_ntz")
    legs = spark.createDataFrame([("v", 5, summer + timedelta(minutes=85)), ("v", 6, summer + timedelta(minutes=25))],
                                 "vehicle_id string, leg_id long, start timestamp_ntz")
    got = {r.leg_id: r.trip_id for r in rc.leg_session_join(legs, sessions).collect()}
    assert got == {5: 2, 6: 2}


def duplicates(rows, window, tolerance):
    kept, out = [], {}
    for r in sorted(rows, key=lambda x: (x[2], x[1])):
        for k in kept:
            if abs(k[2] - r[2]) > window:
                continue
            if k[3] > 0 and r[3] > 0 and abs(k[3] - r[3]) / max(k[3], r[3]) > tolerance:
                continue
            out[r[1]] = k[1]
            break
        else:
            kept.append(r)
    return out


def test_duplicate_legs_random(spark):
    rnd = random.Random(31)
    rows, want = [], {}
    for v in range(8):
        mine = [(f"v{v}", v * 1000 + k, rnd.randrange(30_000), rnd.choice([0.0, 5.0, 5.3, 8.0]), 1.0)
                for k in range(rnd.choice([1, 2, 70]))]
        rows += mine
        want.update(duplicates(mine, 600, 0.10))
    got = rc.leg_dedup(legs_of(spark, rows), segment_rows=9).collect()
    assert {r.leg_id: r.kept_id for r in got} == want


@pytest.mark.parametrize("gap,a,b,dup", [(600, 10.0, 9.0, True), (601, 10.0, 10.0, False), (10, 10.0, 8.9, False)])
def test_duplicate_leg_boundaries(spark, gap, a, b, dup):
    got = rc.leg_dedup(legs_of(spark, [("v", 1, 0, a, 1.0), ("v", 2, gap, b, 1.0)])).collect()
    assert [r.leg_id for r in got] == ([2] if dup else [])


def nearest(trips, legs, window, tolerance):
    used, out = set(), {}
    legs = sorted(((g[0], g[1], g[2] - 3600, g[3]) for g in legs), key=lambda g: (g[2], str(g[1])))
    for t in sorted(trips, key=lambda r: (r[2], str(r[1]))):
        best = None
        for g in legs:
            delta = abs(t[2] - g[2])
            if g[1] in used or delta > window:
                continue
            if t[6] and g[3] and abs(t[6] - g[3]) / max(t[6], 0.01) > tolerance:
                continue
            if best is None or delta < best[0]:
                best = (delta, g[1])
        out[str(t[1])] = None if best is None else str(best[1])
        if best:
            used.add(best[1])
    return out


def test_nearest_pairs_random(spark):
    rnd = random.Random(41)
    trips = [("v", k, rnd.randrange(20_000), None, 1, 1.0, rnd.choice([0.0, 5.0, 6.5])) for k in range(60)]
    legs = [("v", 500 + k, 3600 + rnd.randrange(20_000), rnd.choice([0.0, 5.0, 6.0]), 1.0) for k in range(60)]
    got = rc.correlate_nearest(trips_of(spark, trips), legs_of(spark, legs), segment_rows=11).collect()
    assert {r.trip_id: r.leg_id for r in got if r.trip_id is not None} == nearest(trips, legs, 600, 0.20)
    taken = {r.leg_id for r in got if r.trip_id is not None and r.leg_id}
    assert {r.leg_id for r in got if r.trip_id is None} == {str(g[1]) for g in legs} - taken


def test_score_of_a_close_pair(spark):
    got = rc.match_score_join(trips_of(spark, [("v", 1, 0, 600, 1, 10.0, 10.0)]),
                              legs_of(spark, [("v", 2, 360, 9.0, 8.0), ("v", 3, 3601, 10.0, 10.0),
                                              ("v", 4, 0, 6.9, 10.0)])).collect()
    assert [r.leg_id for r in got] == [2]
    assert abs(got[0].score - (0.4 * 0.9 + 0.5 * (1 - 0.1 / 0.3) + 0.1 * 0.8)) < 1e-12


def test_reconcile_again_changes_nothing(spark):
    rnd = random.Random(51)
    trips = [("v", k, s, s + rnd.randrange(200, 3000), rnd.randrange(5), 10.0, rnd.uniform(1, 20))
             for k, s in enumerate(sorted(rnd.sample(range(60_000), 30)))]
    legs = [("v", 900 + k, rnd.randrange(60_000), rnd.uniform(1, 20), 5.0) for k in range(40)]
    t = trips_of(spark, trips)
    for c in ("fuel_l", "max_speed_kmh", "avg_speed_kmh", "l100km"):
        t = t.withColumn(c, F.lit(1.0))
    t = t.withColumn("alerts", F.expr("cast(array() as array<int>)")).withColumn("vin", F.lit(None).cast("string"))
    g = legs_of(spark, legs)
    for c in ("fuel_l", "cost", "price_fuel"):
        g = g.withColumn(c, F.lit(1.0))
    for c in ("fuel_level", "fuel_autonomy", "days_to_service", "km_to_service"):
        g = g.withColumn(c, F.lit(5))
    g = (g.withColumn("maintenance_passed", F.lit(False)).withColumn("vin", F.lit("VIN"))
         .withColumn("alerts", F.array(F.lit(3))))
    first = rc.reconcile(t, g)
    kept = {r.trip_id for r in first.trips.collect()}
    legs_left = {r.leg_id for r in first.legs.collect()}
    shuffled = rc.reconcile(t.orderBy(F.desc("trip_id")), g.orderBy(F.desc("leg_id")))
    assert {r.trip_id for r in shuffled.trips.collect()} == kept
    again = rc.reconcile(first.trips.select(t.columns), first.legs)
    assert {r.trip_id for r in again.trips.collect()} == kept
    assert {r.leg_id for r in again.legs.collect()} == legs_left
    totals = first.trips.agg(F.sum("distance_km")).collect()[0][0]
    gone = {r.trip_id for r in first.removed.collect()}
    assert abs(totals - sum(x[6] for x in trips if x[1] not in gone)) < 1e-9


def test_decisions_alone_are_those_of_the_whole_pass_and_carry_nothing_else(spark):
    from tripweave.plans import q_reconcile as q, views as v

    d, how = "/root/testdata/sf0.001", {"gap_s": q.GAP_S, "dedupe_s": q.DEDUPE_S, "bucket_s": q.BUCKET_S}
    trips, legs = v.trips(spark, d), v.legs(spark, d)
    alone, whole = rc.decide(trips, legs, **how), rc.reconcile(trips, legs, **how)
    for name in ("removed", "chains", "assigned", "duplicates"):
        got, want = getattr(alone, name), getattr(whole, name)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name
    assert {*alone.merged.columns} == {*rc.DECIDING_TRIPS, "merged"} and {*alone.free.columns} == {*rc.DECIDING_LEGS}
