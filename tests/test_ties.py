"""Decisions on computed doubles that lie exactly on their limit, and streams whose parts are several files."""

import tempfile

from pyspark.sql import functions as F

from tripweave.operators import reconcile as rc, trends as tr


def test_a_slope_of_exactly_the_limit_is_not_falling(spark):
    values = [210.0, 242.0, 176.0, 173.0, 184.0, 158.0, 170.0]           # regr_slope: -10.000000000000002
    steep = [v - (i == 6) for i, v in enumerate(values)]
    rows = spark.createDataFrame([(v, i, f"2026-05-0{i + 1} 10:00:00", y, ["obd"]) for v, ys in enumerate((values, steep))
                                  for i, y in enumerate(ys)],
                                 "vehicle_id long, trip_id long, start string, km double, sources array<string>")
    rows = rows.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("source", F.lit("obd_csv"))
    got = {r.vehicle_id: r.falling for r in tr.linear_slope(rows.coalesce(1), "km", -10.0).collect()}
    assert got == {0: False, 1: True}


def test_the_order_of_adding_fuel_decides_nothing(spark):
    rows = spark.createDataFrame([(1, 17.0, 20.0), (2, 17.0, 19.999999999999996), (3, 23.0, 19.999999999999996),
                                  (4, 16.9, 20.0)], "trip_id long, fuel_l double, cloud_fuel_l double").selectExpr(
        "*", "1e0 AS distance_km", "1e0 AS cloud_distance_km", "timestamp_ntz'2026-05-01 10:00:00' AS start",
        "timestamp_ntz'2026-05-01 10:00:00' AS cloud_start")
    got = {r.trip_id: r.fuel_agrees for r in rc.source_cross_check(rows).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_late_legs_of_parts_with_several_files(spark):
    import duckdb

    from tripweave.plans import ORACLES, QUERIES

    folder, con = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), duckdb.connect()
    for name in ("orders", "lineitem"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        rows.repartition(3).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 30)            # every file is a task, so every part is three files
    try:
        got = sorted((r.trip_id, r.leg_id or 0, str(r.leg_start)) for r in QUERIES["stream_enrich_late"](spark, folder).collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = con.execute(ORACLES["stream_enrich_late"]).fetchall()
    assert got == sorted((t, g or 0, str(s)) for t, g, s in want)


def test_slopes_at_the_limit_are_decided_as_the_sql_does(spark):
    import duckdb

    from tripweave.plans import ORACLES, QUERIES

    rows = {73231: "663879 1995-10-24, 735797 1996-04-01, 721947 1996-09-25, 636131 1996-11-10, 674966 1998-07-11, "
                   "640317 1998-12-14, 669666 1998-12-31, 604389 2000-01-18, 645929 2001-02-17",         # -10.000000000000002
            26642: "154361 1996-01-06, 164462 1996-08-25, 191035 1996-08-31, 193821 1997-10-19, 198649 1998-09-18, "
                   "236344 1999-04-12, 278557 1999-04-17, 168343 2000-03-28, 288723 2001-02-02, 238166 2001-03-04"}
    folder, con = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), duckdb.connect()
    given = ", ".join(f"({o}, {v}, TIMESTAMP '{day}')" for v, text in rows.items()
                      for o, day in (pair.split() for pair in text.split(", ")))
    con.execute(f"COPY (SELECT t.* REPLACE (CAST(k AS BIGINT) AS o_orderkey, CAST(v AS BIGINT) AS o_custkey, day AS o_orderdate) "
                f"FROM (VALUES {given}) g(k, v, day), (FROM '/root/testdata/sf0.001/orders.parquet' LIMIT 1) t) "
                f"TO '{folder}/orders.parquet' (FORMAT parquet)")
    con.execute(f"COPY (FROM '/root/testdata/sf0.001/lineitem.parquet') TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    want = sorted(con.execute(ORACLES["linear_slope"]).fetchall())
    assert sorted(map(tuple, QUERIES["linear_slope"](spark, folder).collect())) == want
    assert [r[3] for r in want] == [False, True]
