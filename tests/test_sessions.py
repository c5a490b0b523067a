"""Live sessions equal the batch operators; the run monoid equals plain Python."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tripweave.operators import dpf, pid_stats as ps, runs, samples as sm
from tripweave.streaming import sessions

ANCHORS = ["rpm", "speed"]
RULES = dpf.DpfRules(sensors={"status": "status", "enable": "enable", "egt_after": "egt", "nox_cat": "nox", "inlet": "in",
                              "outlet": "out", "soot": "soot", "distance": "km"}, reset_from=5.0, reset_share=0.5)
GAP_S, CHUNK_S, DELAY_S = 60.0, 40.0, 3000.0


def best_run(flags):
    best = run = 0
    for f in flags:
        run = run + 1 if f else 0
        best = max(best, run)
    return best


def test_pieces_join_in_any_way(spark):
    r, rows = random.Random(4), []
    for i in range(300):
        flags = [r.random() < r.choice([.1, .5, .9, 1]) for _ in range(r.randrange(0, 30))]
        parts, at = [], 0
        while at < len(flags) or not parts:
            n = r.randrange(0, 8)
            parts.append(flags[at:at + n])
            at += n
        rows.append((i, flags, parts))
    df = spark.createDataFrame(rows, "i int, flags array<boolean>, parts array<array<boolean>>")
    got = df.select("i", runs.run_piece(F.col("flags")).alias("whole"),
                    runs.fold_pieces(F.transform("parts", runs.run_piece)).alias("folded")).collect()
    for row in got:
        flags = rows[row.i][1]
        assert row.whole == row.folded
        assert (row.whole.best, row.whole.n) == (best_run(flags), len(flags))


@pytest.mark.parametrize("chunk_rows", [1, 3, 1000])
def test_longest_run(spark, chunk_rows):
    r = random.Random(chunk_rows)
    rows = [(g, i, r.random()) for g in range(5) for i in range(40)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, seq long, value double").repartition(4)
    got = {x.g: x.longest_run for x in runs.longest_run(df, ["g"], F.col("value") < 0.7, chunk_rows=chunk_rows).collect()}
    for g in range(5):
        assert got[g] == best_run(v < 0.7 for _, _, v in sorted(x for x in rows if x[0] == g))


def drive(seed, vehicles=4):
    """(vehicle, micros, seq, pid, value, unit): sessions of some minutes with pauses, anchors that come late or never."""
    r, rows, seq = random.Random(seed), [], 0
    for v in range(vehicles):
        t = r.randrange(100)
        for _ in range(3):
            pids = r.sample(["rpm", "speed", "status", "enable", "egt", "nox", "in", "out", "soot", "km", "Flag"], r.randrange(3, 11))
            level = 40.0
            for _ in range(r.randrange(5, 90)):
                t += r.choice([0, 1, 2, 5, 30])
                pid = r.choice(pids)
                level = max(0.0, level - r.randrange(9) / 8) if r.random() < .97 else 1.0
                value = {"km": level, "status": float(r.random() < .3), "Flag": float(r.random() < .5), "egt": r.randrange(400, 600) * 1.0
                         }.get(pid, r.randrange(24) / 8)           # eighths: sums are exact in any order
                rows.append((v, t * 1_000_000, seq, pid, value, r.choice(["", "u"])))
                seq += 1
            t += r.choice([61, 400, 5000])
    return rows


def batch(spark, rows):
    """The same by the batch operators: sessions cut in Python, order as a number."""
    out, sessions_ = [], {}
    for v in sorted({x[0] for x in rows}):
        mine, start, before = sorted(x for x in rows if x[0] == v), None, None
        for x in mine:
            if before is None or (x[1] - before) / 1e6 > GAP_S:
                start = x[1]
            before = x[1]
            sessions_.setdefault((v, start), []).append(x)
    newest = max(x[1] for x in rows) / 1e6
    for (v, start), mine in sessions_.items():
        for i, x in enumerate(sorted(mine, key=lambda x: (x[1], x[2]))):
            out.append((f"{v}@{start}", i, x[1] / 1e6, x[3], x[4], x[5]))
    df = spark.createDataFrame(out, "trip_id string, seq long, sec double, pid string, value double, unit string").repartition(4)
    _, clipped = sm.windowed_samples(df, ANCHORS, chunk_rows=10)
    slugs = spark.createDataFrame([("rpm", "turns"), ("speed", "turns")], "pid string, curated_slug string")
    stats = ps.pid_stats(clipped, sm.sensor_facts(df), slugs).drop("first_seq")
    state = dpf.dpf_state(clipped, RULES, chunk_rows=10)
    closed = {f"{v}@{s}": max(x[1] for x in m) / 1e6 + GAP_S + DELAY_S < newest for (v, s), m in sessions_.items()}
    return slugs, {(r.trip_id, r.slug): r for r in stats.collect()}, {r.trip_id: r for r in state.collect()}, closed


def stream(spark, parts):
    inbox, out, mark = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(3))
    out += "/chunks"
    schema = "vehicle_id long, us long, seq long, pid string, value double, unit string"
    for part in parts:
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(inbox)
        rows = spark.readStream.schema(schema).parquet(inbox).withColumn("ts", F.timestamp_micros("us"))
        sessions.store_summaries(sessions.chunk_summaries(rows, f"{CHUNK_S:.0f} seconds", f"{DELAY_S:.0f} seconds", GAP_S, ANCHORS,
                                                          RULES), out, mark).awaitTermination()
    return sessions.current(spark, out)


def shuffled_parts(rows, seed):
    """Three batches in which rows come up to 2,900 seconds late."""
    r = random.Random(seed)
    by_arrival = sorted(rows, key=lambda x: x[1] + r.randrange(2_900_000_000))
    n = len(by_arrival) // 3
    return [by_arrival[:n], by_arrival[n:2 * n], by_arrival[2 * n:]]


def test_statistics_and_state_equal_the_batch_operators(spark, seed=2):
    rows = drive(seed)
    slugs, stats, states, closed = batch(spark, rows)
    chunks = stream(spark, shuffled_parts(rows, seed)).cache()
    got = sessions.session_statistics(chunks, slugs, GAP_S, DELAY_S, CHUNK_S, ANCHORS).drop("first_seq").collect()
    assert len(got) == len(stats)
    for row in got:
        want = stats[row.trip_id, row.slug]
        assert row.closed == closed[row.trip_id]
        for c in want.__fields__:
            assert row[c] == want[c], (row.trip_id, row.slug, c)
    made = sessions.session_dpf_state(chunks, GAP_S, DELAY_S, CHUNK_S, ANCHORS, RULES).collect()
    assert len(made) == len(states) and len({r.dpf_state for r in made}) > 1
    for row in made:
        assert all(row[c] == states[row.trip_id][c] for c in states[row.trip_id].__fields__)
    assert {True, False} == set(closed.values())
    shut = {(r.vehicle_id, r.chunk): r.closed for r in chunks.select("vehicle_id", "chunk", "closed").distinct().collect()}
    assert any(shut.values()) and not all(shut.values())           # timers have closed old chunks only


def test_samples_behind_the_watermark_do_not_reopen_a_closed_chunk(spark):
    t = 1_000_000_000_000                                          # a chunk's start
    row = (1, t, 0, "rpm", 1.0, "u")
    late = [(1, t + 10_000_000, 1, "rpm", 9.0, "u")]
    far = [(1, t + 9_000_000_000, 2, "rpm", 2.0, "u")]
    chunks = stream(spark, [[row], far, late + far, far]).collect()
    assert [(r.n, r.closed) for r in chunks if r.chunk == 25_000] == [(1, True)]


def test_zones_lie_inside_or_outside_of_any_window():
    import numpy as np

    sec = np.array([0, 1, 2, 2, 3, 4, 5.0])
    pid = np.array(["x", "rpm", "x", "rpm", "x", "speed", "x"])
    assert sessions._zones(sec, pid, ANCHORS).tolist() == [0, 1, 3, 3, 4, 5, 6]


def test_the_unit_is_a_sample_s_whatever_the_order_of_summaries(spark):
    import numpy as np

    us = np.array([1, 2, 3]) * 1_000_000
    made = sessions.summarise(us, np.arange(3), np.array(["rpm", "km", "km"], object), np.array([1.0, 2.0, 3.0]),
                              np.array(["u", "u", "u"], object), ANCHORS[:0], GAP_S, "km", 1.0)
    n = len(made["n"])
    made |= {"vehicle_id": [1] * n, "chunk": [0] * n, "closed": [False] * n}
    for step in (1, -1):                                           # readings last and first
        rows = [tuple(x.item() if isinstance(x, np.generic) else x for x in (made[c][i] for c in sessions._NAMES))
                for i in range(n)][::step]
        chunks = spark.createDataFrame(rows, sessions.SUMMARY.format(vehicle="long")).coalesce(1).withColumn(
            "first_at", F.struct("first_us", "first_seq")).withColumn("last_at", F.struct("last_us", "last_seq"))
        stats = sessions.session_statistics(chunks, spark.createDataFrame([("x", "y")], "pid string, curated_slug string"),
                                            GAP_S, DELAY_S, CHUNK_S, ANCHORS[:0])
        assert {r.pid: r.unit for r in stats.collect()} == {"rpm": "u", "km": "u"}


def test_a_call_summarises_many_vehicles_as_if_each_came_alone():
    import numpy as np

    rows = drive(7, vehicles=6)
    random.Random(7).shuffle(rows)
    vehicle, us, seq, pid, value, unit = (np.array(c, object) for c in zip(*rows))
    owner = np.array([None if v == 5 else str(v) for v in vehicle], object)
    cols = us.astype(np.int64), seq.astype(np.int64), pid, value.astype(float), unit

    def lines(made, names, mine):
        return sorted(repr([made[c][i] for c in names]) for i in range(len(made["n"])) if made["vehicle_id"][i] == mine)

    every = sessions.summarise(*cols, ANCHORS, GAP_S, "km", 1.0, vehicle=owner)
    for v in set(owner):
        at = np.flatnonzero(owner == v)
        alone = sessions.summarise(*[c[at] for c in cols], ANCHORS, GAP_S, "km", 1.0)
        names = list(alone)
        assert lines(every, names, v) == lines(alone | {"vehicle_id": [v] * len(alone["n"])}, names, v) != []


def test_vehicles_share_state_keys(spark):
    """400 vehicles in two buckets are four keys, and every vehicle has its own rows and its own closing."""
    inbox, out, mark = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(3))
    t = 1_000_000_000_000                                          # a chunk's start
    schema = "vehicle_id long, us long, seq long, pid string, value double, unit string"
    kept = []
    for part in ([(v, t + v, 0, "rpm", 1.0, "u") for v in range(400)], [(v, t + 9_000, 1, "rpm", 3.0, "u") for v in range(200)],
                 [(v, t + 9_000_000_000, 2, "rpm", 2.0, "u") for v in range(400)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(inbox)
        rows = spark.readStream.schema(schema).parquet(inbox).withColumn("ts", F.timestamp_micros("us"))
        made = sessions.chunk_summaries(rows, f"{CHUNK_S:.0f} seconds", f"{DELAY_S:.0f} seconds", GAP_S, ANCHORS, RULES, buckets=2)
        query = sessions.store_summaries(made, out + "/chunks", mark)
        query.awaitTermination()
        kept += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert 0 < max(kept) <= 4
    rows = sessions.current(spark, out + "/chunks").where("chunk = 25000").collect()
    assert sorted((r.vehicle_id, r.n, r.closed) for r in rows if r.rounded == 1.0) == [(v, 1, True) for v in range(400)]
    assert sorted((r.vehicle_id, r.n) for r in rows if r.rounded == 3.0) == [(v, 1) for v in range(200)]


def test_buckets_grow_with_the_rows():
    assert [sessions.bucket_count(n) for n in (0, 1, 16_384, 16_385, 36_000_000)] == [1, 1, 1, 2, 2198]
