"""Native formats: text logs, cloud exports, binary logs, stored tables, streams."""

import json
import struct
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tripweave import fixed_values as fv
from tripweave.operators import trip_fields as tf
from tripweave.plans.q_sources import encode_log
from tripweave.sources import cloud_json as cj, sensor_binary as sb, sensor_csv as sc, tables as tb
from tripweave.streaming import live

HEADER = "﻿SECONDS;PID;VALUE;UNITS;LATITUDE;LONGTITUDE;\n"


def folder(files: dict) -> str:
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, content in files.items():
        with open(f"{d}/{name}", "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())
    return d


LOG = HEADER + "".join([
    "10.0;Giri motore;800;rpm;40.5;14.7;\n", "bad;Giri motore;1;rpm;;;\n", "11.0;x\n", "11.5;Giri motore;n/a;rpm;0;0;\n",
    "12.0; Velocità (GPS) ;36.0;km/h;40.5;x;\n", "13.0;[ECM] Fuel consumption rate;3.6;L/h;;;\n",
    "0:00:14,5;Velocità (GPS);72.0;km/h;40.6;14.8;\n", "15.0;[ECM] Fuel consumption rate;7.2;L/h;40.6;14.8;\n",
    "20.0;Giri motore;1000.5;rpm;40.6;14.8;\n", "99.0;[ECM] Oil temperature;80;°C;0;0;\n",
    "16.0;Distanza percorsa:;12.345;km;0;0;\n"])


def test_read_log_folder(spark):
    d = folder({"2026-05-20 19-57-16.csv": LOG, "2026-05-21_08-00-00.csv": HEADER})
    rows = sc.scan_samples(spark, d).orderBy("seq").collect()
    assert [(r.sec, r.value) for r in rows] == [
        (10.0, 800.0), (12.0, 36.0), (13.0, 3.6), (14.5, 72.0), (15.0, 7.2), (20.0, 1000.5), (99.0, 80.0), (16.0, 12.345)]
    assert rows[1].pid == "Velocità (GPS)" and (rows[1].lat, rows[1].lon) == (0.0, 0.0)
    assert {r.trip_id for r in rows} == {"obd-2026-05-20_19-57-16"}
    sniffed = sc.scan_samples(spark, d, delimiter=None).orderBy("seq").drop("seq").collect()
    assert sniffed == sc.scan_samples(spark, d).orderBy("seq").drop("seq").collect()
    empty = sc.empty_files(sc.list_files(spark, d), sc.scan_samples(spark, d)).collect()
    assert [r.filename for r in empty] == ["2026-05-21_08-00-00.csv"]
    bad = sc.rejected(sc.parse_lines(sc.read_lines(spark, d))).orderBy("seq").collect()
    assert [r.reason for r in bad] == ["bad time", "too few fields", "bad value"]


def test_other_delimiters(spark):
    text = HEADER + "1.5;a;2;u;1;2;\n2.5;a;3;u;1;2;\n"
    d = folder({"a.csv": text, "b.csv": text.replace(";", ","), "c.csv": text.replace(";", "\t"), "d.csv": "x\ny\n"})
    found = {r.path.split("/")[-1]: r.delimiter for r in sc.sniff_delimiters(sc.read_lines(spark, d)).collect()}
    assert found == {"a.csv": ";", "b.csv": ",", "c.csv": "\t", "d.csv": None}
    rows = sc.scan_samples(spark, d, delimiter=None)
    assert {(r.filename, r["n"]) for r in rows.groupBy("filename").agg(F.count("*").alias("n")).collect()} == {
        ("a.csv", 2), ("b.csv", 2), ("c.csv", 2)}


def test_trip_summary_from_a_log(spark):
    d = folder({"2026-05-20 19-57-16.csv": LOG, "2026-05-20 21-00-00.csv": HEADER + "1;Giri motore;5;rpm;0;0;\n"})
    samples = sc.scan_samples(spark, d)
    trips = tf.trip_summaries(samples, sc.file_table(samples), spark).collect()
    assert len(trips) == 1                                   # the second log is too short a trip
    t = trips[0]
    assert t.start == datetime(2026, 5, 20, 19, 57, 16) and t.start_utc == datetime(2026, 5, 20, 17, 57, 16)
    assert t.end == datetime(2026, 5, 20, 19, 57, 26) and t.duration_min == 0.2
    assert (t.distance_km, t.distance_source) == (round(12.345, 2), "trip_counter")
    assert (t.avg_rpm, t.max_rpm) == (900, 1000) and t.avg_speed_kmh == 54.0 and t.fuel_l == 0.003
    assert t.oil_temp_max_c is None                          # outside the engine window
    assert t.dpf_state == "idle" and t.pid_count == 4 and t.odometer_km == 12


def test_cloud_export_shapes(spark):
    trip = {"id": 7, "start": {"date": "2026-05-20T10:00:00Z", "mileage": 100},
            "end": {"date": "2026-05-20T10:20:00Z", "mileage": 0}, "distance": 11.9, "travelTime": 1200,
            "fuelConsumption": 532536, "priceFuel": 1.7, "alerts": [27, 3.0], "fuelLevel": 50}
    short = {**trip, "id": 8, "distance": 0.4}
    bare = {"id": 9, "start": {"date": "2026-05-21T10:00:00Z"}, "end": {"date": ""}, "distance": 2}
    d = folder({"a.myop": json.dumps([{"vin": "V1", "trips": [trip, short]}]),
                "b.json": json.dumps({"vin": "V2", "trips": [bare]})})
    legs = {r.leg_id: r for r in cj.parse_leg(cj.scan_trip_json(spark, d)).collect()}
    assert set(legs) == {"myop-7", "myop-9"}
    a, b = legs["myop-7"], legs["myop-9"]
    assert a.start == datetime(2026, 5, 20, 10) and a.fuel_l == 0.533 and a.l100km == 4.48
    assert a.avg_speed_kmh == 35.7 and a.cost == 0.91 and a.alerts == [27, 3] and a.odometer_km == 100
    assert b.end is None and b.fuel_l == 0.0 and b.cost is None and b.avg_speed_kmh is None and b.alerts == []


def test_binary_log(spark):
    rows = [(0.0, "rpm", 800.0), (0.5, "Altitudine GPS", 12.0), (1.0, "rpm", 900.0)]
    data = encode_log(rows, ["rpm", "Altitudine GPS"])
    ident = struct.pack("<I", 4097)
    data = data.replace(ident, fv.BINARY_ALTITUDE_ID)
    place = b"\1\2\3\4" + struct.pack("<ddd", 9.0, 40.5, 14.7)
    data += fv.BINARY_RECORD_MARK + struct.pack("<d", 2.0) + fv.BINARY_ALTITUDE_ID + struct.pack("<d", 13.0) + place
    data += fv.BINARY_RECORD_MARK + struct.pack("<d", 3.0) + struct.pack("<I", 4096) + struct.pack("<d", 950.0)
    d = folder({"2026-05-20 19-57-16.brc": data})
    got = sb.scan_samples(spark, d).orderBy("seq").collect()
    assert [(r.sec, r.pid, r.value) for r in got] == [*rows, (2.0, "Altitudine GPS", 13.0), (3.0, "rpm", 950.0)]
    assert [(r.lat, r.lon) for r in got][3] == (40.5, 14.7)
    assert got[0].trip_id == "obd-2026-05-20_19-57-16"


def test_stored_tables(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "trip_id long, version long, x string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "trip_id long, version long, x string")
    assert {(r.trip_id, r.x) for r in tb.upsert(old, new).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert [r.trip_id for r in tb.ingest_incremental(new, old).collect()] == [3]
    path = folder({}) + "/trips"
    days = old.withColumn("start", F.expr("timestamp_ntz'2026-05-01 23:59:00' + make_dt_interval(cast(trip_id as int))"))
    tb.write_keyed(days, path, buckets=4)
    moved = days.filter("trip_id = 2").selectExpr("trip_id", "version + 1 AS version", "'z' AS x",
                                                  "start + INTERVAL 2 MINUTES AS start")     # over midnight
    tb.upsert_keyed(spark, path, moved, buckets=4)
    tb.upsert_keyed(spark, path, moved, buckets=4)
    got = tb.read_trips(spark, path).collect()
    assert sorted((r.trip_id, r.x, r.version) for r in got) == [(1, "a", 1), (2, "z", 2)]
    assert {r.start.day for r in got if r.trip_id == 2} == {4}


def test_export_numbers_and_rejects(spark):
    leg = {"id": 7.0, "start": {"date": "2026-05-20T10:00:00Z"}, "end": {"date": "2026-05-20T10:20:00Z"},
           "distance": 10, "travelTime": 1800.0, "fuelConsumption": 500000.0, "priceFuel": 2}
    text = json.dumps([{"vin": "V1", "trips": [leg]}])
    d = folder({"a.json": text, "b.json": text[:-20]})
    one, = cj.parse_leg(cj.scan_trip_json(spark, d)).collect()
    assert (one.leg_id, one.duration_min, one.fuel_l, one.cost) == ("myop-7", 30.0, 0.5, 1.0)
    bad, = cj.rejected_exports(spark, d).collect()
    assert bad.path.endswith("b.json") and "V1" in bad.text and bad.reason == "not JSON"


def test_one_bad_value_costs_one_trip(spark):
    """Texts for numbers, odd vehicles, cut files: what is good stays, what isn't is named with its place."""
    def leg(i, **more):
        return {"id": i, "start": {"date": "2026-05-20T10:00:00Z"}, "distance": 5.0, "travelTime": 1800, **more}

    d = folder({
        "a.json": json.dumps([{"vin": "V1", "trips": [leg(1), leg(2, travelTime="1800"), leg(3, other={"distance": "far"})]},
                              {"vin": "V2", "trips": "x"}, {"vin": 5, "trips": [leg(4)]}, 7, None, {"vin": "V6"}]),
        "b.myop": json.dumps([{"vin": "V3", "trips": [leg(5)]}])[:-10],
        "c.json": json.dumps({"vin": "V4", "trips": [leg(6, alerts=[27, "31", True, 2.9, None, [1]]), 3, None,
                                                     leg(7, start="now", priceFuel=[1]), leg(8, end=None, alerts=None)]}),
        "d.json": "[]", "e.json": "", "f.json": '{"vin": "V9", "trips": null}', "g.json": json.dumps({"vin": "V7", "trips": [leg(9)]})})
    parsed = cj.parsed_exports(spark, d).cache()
    legs = {r.leg_id: r for r in cj.parse_leg(cj.good_trips(parsed)).collect()}
    assert set(legs) == {f"myop-{i}" for i in (1, 3, 4, 6, 8, 9)}
    assert legs["myop-6"].alerts == [27, 1, 2] and legs["myop-8"].alerts == [] and legs["myop-4"].vin == "5"
    bad = sorted((r.path[-6:], r.vehicle_no if r.vehicle_no is not None else -1, r.trip_no if r.trip_no is not None else -1, r.vin,
                  r.reason) for r in cj.rejects(parsed).collect())
    assert bad == [("a.json", 0, 1, "V1", "travelTime is text"), ("a.json", 1, -1, "V2", "trips is text"),
                   ("a.json", 3, -1, "", "vehicle is a number"), ("a.json", 4, -1, "", "vehicle is null"),
                   ("b.myop", -1, -1, "", "not JSON"), ("c.json", 0, 1, "V4", "trip is a number"),
                   ("c.json", 0, 2, "V4", "trip is null"), ("c.json", 0, 3, "V4", "priceFuel is a list; start is text")]
    assert cj.rejected_exports(spark, d).count() == 8


def test_long_position_block_and_marks_inside_values(spark):
    mark = struct.unpack("<d", fv.BINARY_RECORD_MARK + fv.BINARY_RECORD_MARK)[0]
    rows = [(0.0, "rpm", 800.0), (0.5, "rpm", mark), (1.0, "rpm", 900.0)]
    data = encode_log(rows, ["rpm"])
    assert len(data) > 1500
    d = folder({"2026-05-20 19-57-16.brc": data})
    got = sb.scan_samples(spark, d).orderBy("seq").collect()
    assert [(r.sec, r.value) for r in got] == [(s, x) for s, _, x in rows]


def test_decoding_a_log_takes_no_multiple_of_its_size():
    import tracemalloc

    data = encode_log([(i * .5, "rpm", i * 1.0) for i in range(200_000)], ["rpm"])
    tracemalloc.start()
    n = sum(len(batch) for batch in sb.record_batches(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and peak < len(data)


@pytest.mark.parametrize("window", [1, 24, 100, 1 << 18])
def test_records_do_not_depend_on_the_window(window):
    mark = struct.unpack("<d", fv.BINARY_RECORD_MARK + fv.BINARY_RECORD_MARK)[0]
    rows = [(float(i), n, mark if i % 3 == 0 else 1.0) for i, n in enumerate(["rpm", "Altitudine GPS", "x" * 9] * 20)]
    data = encode_log(rows, ["rpm", "Altitudine GPS", "x" * 9]).replace(struct.pack("<I", 4097), fv.BINARY_ALTITUDE_ID)
    want = [(*rows[i], 0.0, 0.0) for i in range(60)]
    for k, lat in enumerate([40.5, mark, 41.5]):                      # a position that looks like a mark, at its 12th byte
        data += fv.BINARY_RECORD_MARK + struct.pack("<d", 90.0 + k) + fv.BINARY_ALTITUDE_ID + struct.pack("<d", 2.0)
        data += b"\1\2\3\4" + struct.pack("<ddd", 9.0, lat, 14.7)
        want.append((90.0 + k, "Altitudine GPS", 2.0, lat, 14.7))
    got = [tuple(r.values()) for batch in sb.record_batches(data, window) for r in batch.to_pylist()]
    assert sorted(got) == sorted(want) and got[60:] == want[60:]


def test_bucketed_samples_join_without_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 5 AS trip_id", "id AS seq", "id * 1.0e0 AS sec", "'p' AS pid",
                                        "1.0e0 AS value", "'' AS unit", "0.0e0 AS lat", "0.0e0 AS lon")
    spark.sql("DROP TABLE IF EXISTS samples_bucketed")
    tb.write_samples(rows, "samples_bucketed", buckets=4, path=folder({}) + "/t")
    t = spark.table("samples_bucketed")
    plan = t.groupBy("trip_id", "chunk").agg(F.max("sec"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE samples_bucketed")


def test_stream_equals_batch(spark):
    d = folder({"2026-05-20 19-57-16.csv": LOG, "2026-05-22 19-57-16.csv": LOG})
    out, mark = folder({}) + "/out", folder({})
    live.ingest_lines(live.stream_lines(spark, d, files=1), out, mark).awaitTermination()
    stored = spark.read.option("recursiveFileLookup", True).parquet(out)
    cols = ["path", "sec", "pid", "value", "unit", "lat", "lon"]
    want = sc.scan_samples(spark, d).select(cols)
    assert sorted(map(str, stored.select(cols).collect())) == sorted(map(str, want.collect()))
    live.ingest_lines(live.stream_lines(spark, d, files=1), out, mark).awaitTermination()   # nothing new
    assert spark.read.option("recursiveFileLookup", True).parquet(out).count() == want.count()


def test_from_files_to_insights(spark):
    """Two vehicles' logs and exports through every stage of the library."""
    import os

    from tripweave.operators import reconcile as rc, rules, trips as op

    d = folder({})
    lines = [f"{t};Giri motore;{800 + t};rpm;40.5;{14 + t / 100};\n" for t in range(0, 1200, 60)]
    lines += ["0;[ECM] Fuel consumption rate;3.0;L/h;;;\n", "1140;[ECM] Fuel consumption rate;3.0;L/h;;;\n",
              "1100;Distanza percorsa:;12.0;km;;;\n", "5;[ECM] Evaluation of the degree of dilution of motor oil;6.0;%;;;\n"]
    for vehicle, extra in (("V1", "[ECM] Oil temperature;90"), ("V2", "[ECM] Battery current;3")):
        os.mkdir(f"{d}/{vehicle}")
        with open(f"{d}/{vehicle}/2026-01-20 19-00-00.csv", "w") as f:
            f.write(HEADER + "".join(lines) + f"7;{extra};u;;;\n")
    leg = {"id": 7, "start": {"date": "2026-01-20T19:02:00Z", "mileage": 100}, "end": {"date": "2026-01-20T19:19:00Z",
           "mileage": 112}, "distance": 11.8, "travelTime": 1000, "fuelConsumption": 950000, "priceFuel": 1.7, "alerts": [27],
           "daysUntilNextMaintenance": 40, "distanceToNextMaintenance": 900}
    alone = {**leg, "id": 8, "start": {"date": "2026-01-22T08:00:00Z"}, "end": {"date": "2026-01-22T08:10:00Z"}}
    cloud = folder({"all.myop": json.dumps([{"vin": "V1", "trips": [leg, alone]}])})

    samples = sc.scan_samples(spark, d, vehicle=sc.vehicle_folder())
    stored = tf.trip_summaries(samples, sc.file_table(samples), spark)
    legs = cj.parse_leg(cj.scan_trip_json(spark, cloud))
    result = rc.reconcile(stored, legs)
    gold = op.trip_projection(result.trips)
    rows = {r.vehicle_id: r for r in gold.collect()}
    assert set(rows) == {"V1", "V2"} and rows["V1"].trip_id == "V1/obd-2026-01-20_19-00-00"
    assert rows["V1"].sources == ["obd", "myopel"] and rows["V2"].sources == ["obd"]
    assert rows["V1"].cloud_id == 7 and rows["V1"].alerts == [27] and rows["V1"].price_fuel == 1.7
    assert rows["V1"].fuel_l == 0.95 and abs(rows["V1"].cost - 1.615) < 1e-9 and rows["V1"].vin == "V1"
    assert [r.leg_id for r in result.legs.collect()] == ["myop-8"]
    notes = {(r.vehicle_id, r.title) for r in rules.explode_insights(rules.per_trip_insights(gold), "vehicle_id").collect()}
    assert ("V2", "Diluizione olio 6.0%") in notes and ("V1", "Consumo nella norma · 12.6 km/L") in notes
    everything = op.unify_sources(result.trips, cj.legs_as_trips(result.legs))
    board = {(r.vehicle_id, r.category, r.level) for r in rules.cross_trip_insights(op.trip_projection(everything)).collect()}
    assert ("V1", "service", "warning") in board and ("V2", "engine", "warning") in board


def test_variants_are_read_apart_from_trips_as_they_are(spark):
    """What a damaged trip needs is not part of the compiled code of the good ones, which it would make too long."""
    from tripweave.sources import cloud_json as cj

    docs = spark.createDataFrame([('{"vin":"A","trips":[{"id":1,"distance":2.5}]}',), ('{"vin":"B","trips":[{"id":"x"},7]}',),
                                  ("[1",)], "doc string")
    parsed = cj.parse_documents(docs, "doc")
    assert sorted((r.vin, r.reason) for r in parsed.select("vin", "reason").collect() if r.reason) == [
        ("", "not JSON"), ("B", "id is text"), ("B", "trip is a number")]
    assert [(r.vin, r.trip.id, r.trip.distance) for r in cj.good_trips(parsed).collect()] == [("A", 1.0, 2.5)]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(_t" in plan and "try_variant_get(_t" not in plan
