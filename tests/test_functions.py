"""Column functions against known vectors and plain Python."""

import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tripweave import functions as fx
from tripweave.operators.rules import message

ROME = ZoneInfo("Europe/Rome")


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", expr).orderBy("i").collect()]


def test_round_equals_python(spark):
    rnd = random.Random(3)
    values = ([rnd.uniform(-900, 900) for _ in range(4000)] + [k / 100 for k in range(-2000, 2000)]
              + [k / 8 for k in range(-300, 300)] + [k * 0.0005 for k in range(2000)] + [1e17, -3e20])
    for digits in (0, 1, 2, 3, 6):
        for inline in (True, False):
            got = column(spark, values, "double", fx.py_round("x", digits, inline))
            assert got == [round(x, digits) for x in values]


def test_fixed_equals_python_format(spark):
    values = [k / 40 for k in range(-200, 200)] + [2.675, 0.15, 1234.5]
    assert column(spark, values, "double", fx.fixed("x", 1)) == [f"{x:.1f}" for x in values]


def test_swap_correct_vectors(spark):
    got = column(spark, [1649.0, 3296.94, 2176.75, 4080.75, 90000.0, -1.0], "double",
                 fx.swap_correct("x", F.lit(16.0), F.lit(1.0), F.lit(0.0)))
    assert got[:4] == [262.4375, 252.875, 200.5, 207.9375]
    assert got[4] == 90000.0                       # outside 16 bits: unchanged
    assert got[5] == (((65536 - 16) & 255) << 8 | (65536 - 16) >> 8) / 16


def test_slugs_groups_and_short_names(spark):
    names = ["[ECM] Crankshaft speed", "Giri motore", "  °C ² µ ", "---",
             "[ECM] Exhaust gas temperature after pre-catalytic converter"]
    assert column(spark, names, "string", fx.slugify("x")) == [
        "ecm_crankshaft_speed", "giri_motore", "degc_2_u", "pid",
        "ecm_exhaust_gas_temperature_after_pre_catalytic_converter"]
    groups = ["[ECM] DPF regeneration status", "EGT x", "AdBlue", "Altitudine GPS", "Velocità (GPS)", "?"]
    assert column(spark, groups, "string", fx.sensor_group("x")) == [
        "DPF", "Scarico", "NOx/AdBlue", "Batteria", "GPS", "Sensori"]
    assert column(spark, ["[TCU] Selected gear", "x" * 40], "string", fx.short_name("x")) == [
        "Selected gear", "x" * 32]


def test_parse_seconds(spark):
    given = ["12.5", " 7 ", "1:02:03.5", "1:02:03,5", "2:30", "1,5", "a", "1:x:2", "", None, "1e3", "5d"]
    assert column(spark, given, "string", fx.parse_seconds("x")) == [
        12.5, 7.0, 3723.5, 3723.5, 150.0, None, None, None, None, None, 1000.0, None]


def test_daylight_saving_and_utc(spark):
    rnd = random.Random(5)
    times = [datetime(2020, 1, 1) + timedelta(minutes=rnd.randrange(4 * 525600)) for _ in range(400)]
    times += [datetime(2024, 3, 31, 2, 30), datetime(2024, 10, 27, 2, 30), datetime(2024, 3, 31, 3, 0)]
    got = column(spark, times, "timestamp_ntz", fx.dst_seconds("x"))
    want = [t.replace(tzinfo=ROME).dst().total_seconds() for t in times]
    assert got == want
    utc = column(spark, times[:400], "timestamp_ntz", fx.local_to_utc("x"))
    assert utc == [t.replace(tzinfo=ROME).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
                   for t in times[:400]]


def test_file_names(spark):
    files = ["/d/2026-05-20 19-57-16.csv", "2026-05-20_19-57-16.csv", "other.csv", "2026-13-40_00-00-00.csv"]
    start = datetime(2026, 5, 20, 19, 57, 16)
    assert column(spark, files, "string", fx.local_start_of_file("x")) == [start, start, None, None]
    assert column(spark, files[:2], "string", fx.trip_id_of_file("x")) == ["obd-2026-05-20_19-57-16"] * 2
    assert column(spark, ["obd-2026-05-20_19-57-16", "x"], "string", fx.start_of_trip_id("x")) == [start, None]


def test_trip_ratios(spark):
    df = spark.createDataFrame([(11.9, 0.532536, 1200.0), (10.0, 0.0, 0.0)], "d double, f double, s double")
    a, b = df.select(fx.py_round(fx.km_per_l("d", "f"), 1), fx.l_per_100("f", "d"),
                     fx.average_speed("d", "s")).collect()
    assert a[0] == 22.3 and abs(a[2] - 35.7) < 1e-9
    assert b[0] is None and b[1] is None and b[2] is None


def test_message_fills_templates(spark):
    got = column(spark, [12.25], "double", message("a %.1f%% b %d %s", F.col("x"), F.lit(3), F.lit("z")))
    assert got == ["a 12.2% b 3 z"]


def test_sources(spark):
    df = spark.createDataFrame([("obd_csv", None), ("obd_csv", 5), ("myop", 7), ("myop", None), (None, None)],
                               "source string, cloud_id long")
    assert [r[0] for r in df.select(fx.sources_of()).collect()] == [
        ["obd"], ["obd", "myopel"], ["myopel"], ["myopel"], ["obd"]]
