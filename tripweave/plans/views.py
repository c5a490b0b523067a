"""Telemetry views over the driver tables, as DataFrames and as SQL text.

``events`` becomes sensor samples, ``orders`` with ``lineitem`` become trips,
``lineitem`` becomes cloud legs.  Every view is a projection or a grouped sum of
the whole table; the SQL twin states the same mapping for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave.operators import trips as op
from tripweave.operators.samples import windowed_samples

ANCHORS = ["view", "click"]
CHUNK_ROWS = 65_536

# columns of trips over (o, qty, cents, parts, smin, smax), same text in both engines
_TRIP = [
    ("odometer_km", "o_orderkey * 11 % 200000"),
    ("duration_min", "(qty % 200) * 1440e0 + 7.5e0"),
    ("distance_km", "cents / 1e6"),
    ("fuel_l", "CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN 0e0 "
               "ELSE qty / 8e1 END"),
    ("avg_speed_kmh", "20e0 + o_orderkey * 3 % 60"),
    ("max_speed_kmh", "60e0 + o_orderkey * 7 % 90"),
    ("cloud_id", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 10 END"),
    ("cloud_fuel_l", "CASE WHEN o_orderkey % 3 = 0 THEN qty / 75e0 END"),
    ("price_fuel", "CASE WHEN o_orderkey % 9 = 0 THEN 0e0 WHEN o_orderkey % 3 = 0 "
                   "THEN 1.5e0 + (o_custkey % 50) / 1e2 END"),
    ("dpf_state", "CASE o_orderkey % 8 WHEN 1 THEN 'requested' WHEN 2 THEN 'active' "
                  "WHEN 3 THEN 'completed' WHEN 4 THEN 'post_regen' WHEN 5 THEN NULL ELSE 'idle' END"),
    ("dpf_soot_pct", "CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 13 % 1000) / 1e1 END"),
    ("dpf_closed_soot", "CASE WHEN o_orderkey % 10 <> 3 THEN (o_orderkey * 7 % 100) / 1e1 END"),
    ("dpf_since_regen_km", "CASE WHEN o_orderkey % 5 <> 4 THEN (o_orderkey * 19 % 600) * 1e0 END"),
    ("first_since_regen_km", "(o_orderkey * 23 % 600) * 1e0"),
    ("dpf_avg_regen_km", "CASE WHEN o_orderkey % 7 = 0 THEN 0e0 ELSE 150e0 + o_orderkey * 3 % 300 END"),
    ("dpf_replace_km", "(o_orderkey * 41 % 90000) * 1e0"),
    ("dpf_regen_capability", "(o_orderkey % 100) * 1e0"),
    ("dpf_regen_capability_st", "(o_orderkey * 3 % 100) * 1e0"),
    ("adblue_range_km", "CASE WHEN o_orderkey % 4 <> 1 THEN (o_orderkey * 97 % 8000) * 1e0 END"),
    ("exhaust_after_cat_c", "CASE WHEN o_orderkey % 13 <> 0 THEN 300e0 + o_orderkey * 17 % 500 END"),
    ("air_temp_c", "(o_orderkey * 29 % 40) - 5e0"),
    ("coolant_max_c", "CASE WHEN o_orderkey % 17 = 0 THEN 0e0 ELSE 50e0 + o_orderkey * 5 % 60 END"),
    ("coolant_first_c", "(o_orderkey * 3 % 90) * 1e0"),
    ("km_to_oil_change", "(o_orderkey * 53 % 20000) * 1e0"),
    ("battery_startup_v", "CASE WHEN o_orderkey % 5 <> 0 THEN 8.5e0 + (o_orderkey * 31 % 400) / 1e2 END"),
    ("oil_dilution_pct", "CASE WHEN o_orderkey % 6 <> 5 THEN (o_orderkey * 17 % 80) / 1e1 END"),
    ("ss_state", "o_orderkey % 10"),
    ("fuel_level", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 101 END"),
    ("fuel_autonomy", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 3 % 900 END"),
    ("days_to_service", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 400 - 20 END"),
    ("km_to_service", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 71 % 25000 - 500 END"),
    ("maintenance_passed", "o_orderkey % 50 = 0"),
    ("vin", "CASE WHEN o_orderkey % 3 = 0 THEN concat('VXK', 100000000 + o_custkey) END"),
    ("pid_count", "parts"),
]

# columns of legs over sums per (order, line)
_LEG = [
    ("duration_min", "qty * 9e0"),
    ("distance_km", "cents / 5e5"),
    ("fuel_l", "CASE WHEN leg_id % 7 = 0 THEN 0e0 ELSE qty / 5e1 END"),
    ("price_fuel", "CASE WHEN leg_id % 11 <> 0 THEN 1.5e0 + (leg_id % 40) / 1e2 END"),
    ("fuel_level", "leg_id % 101"),
    ("fuel_autonomy", "leg_id * 3 % 900"),
    ("days_to_service", "leg_id % 400 - 20"),
    ("km_to_service", "leg_id * 71 % 25000 - 500"),
    ("maintenance_passed", "leg_id % 50 = 0"),
    ("vin", "CASE WHEN leg_id % 5 <> 0 THEN concat('VXK', 100000000 + vehicle_id) END"),
]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples: vehicle = user, trip = user and week, order = event id."""
    k = F.get_json_object("props", "$.k").cast("int")
    sec = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6")
    return (table(spark, d, "events").withColumn("sec", sec).withColumn("k", k)
            .select(F.col("user_id").alias("vehicle_id"),
                    F.expr("user_id * 10000 + cast(floor(sec / 604800e0) as bigint)").alias("trip_id"),
                    F.col("event_id").alias("seq"), "sec", F.col("event_type").alias("pid"), "value",
                    F.when(F.col("event_type").isin("error", "signup"), "").otherwise("u").alias("unit"),
                    F.floor(F.col("k") / 10).cast("double").alias("lat"),
                    (F.col("k") % 10).cast("double").alias("lon")))


def windowed(spark: SparkSession, d: str, corrections=None):
    """(trip windows, clipped samples)."""
    return windowed_samples(samples(spark, d), ANCHORS, corrections, CHUNK_ROWS)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with those of one order together, so that counts of an order, of its lines and its join need no exchange more."""
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "cast(l_quantity as bigint) as q", "cast(round(l_extendedprice * 100) as bigint) as c").repartition("l_orderkey")


def trips(spark: SparkSession, d: str) -> DataFrame:
    """Stored trips: vehicle = customer, trip = order."""
    sums = _lines(spark, d).groupBy("l_orderkey").agg(
        F.sum("q").alias("qty"), F.sum("c").alias("cents"),
        F.count_distinct("l_partkey").alias("parts"),
        F.min("l_suppkey").alias("smin"), F.max("l_suppkey").alias("smax"))
    rows = table(spark, d, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    start = F.expr("timestampadd(MINUTE, cast(o_orderkey * 37 % 1440 as int), o_orderdate)")
    end = F.expr("timestampadd(MILLISECOND, CASE WHEN o_orderkey % 4 = 0 THEN 700 ELSE 0 END, "
                 "timestampadd(SECOND, (qty % 200) * 86400 + 450, start))")
    alerts = F.expr("CASE WHEN o_orderkey % 6 = 0 AND smin IS NOT NULL "
                    "THEN array(cast(smin % 168 as int), cast(smax % 168 as int)) "
                    "ELSE cast(array() as array<int>) END")
    out = (rows.withColumn("start", start).withColumn("end", end).withColumn("alerts", alerts)
           .withColumn("vehicle_id", F.col("o_custkey")).withColumn("trip_id", F.col("o_orderkey"))
           .withColumn("source", F.lit("obd_csv"))
           .withColumn("filename", F.concat(F.date_format("start", "yyyy-MM-dd HH-mm-ss"), F.lit(".csv")))
           .selectExpr("vehicle_id", "trip_id", "source", "filename", "start", "end", "alerts",
                       *[f"{e} AS {n}" for n, e in _TRIP]))
    l100 = "CASE WHEN fuel_l > 0 AND distance_km > 0 THEN fuel_l / distance_km * 1e2 END"
    return out.withColumn("l100km", F.expr(l100))


def trips_read(spark: SparkSession, d: str) -> DataFrame:
    """Trips as read: with sources, fallbacks, economy and cost."""
    return op.trip_projection(trips(spark, d))


def legs(spark: SparkSession, d: str) -> DataFrame:
    """Cloud legs: vehicle = customer, leg = order and line number."""
    sums = _lines(spark, d).groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("q").alias("qty"), F.sum("c").alias("cents"), F.min("l_shipdate").alias("ship"),
        F.max("l_partkey").alias("pmax"), F.min("l_suppkey").alias("smin"))
    rows = sums.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"),
                     F.col("o_orderkey") == F.col("l_orderkey"))
    rows = (rows.withColumn("vehicle_id", F.col("o_custkey"))
            .withColumn("leg_id", F.expr("l_orderkey * 10 + l_linenumber"))
            .withColumn("start", F.expr("timestampadd(MINUTE, cast(pmax % 1440 as int), ship)"))
            .withColumn("end", F.expr("timestampadd(MINUTE, cast(qty * 9 as int), start)"))
            .withColumn("alerts", F.expr("CASE WHEN leg_id % 4 = 0 THEN cast(array() as array<int>) "
                                         "ELSE array(cast(smin % 168 as int)) END")))
    out = rows.selectExpr("vehicle_id", "leg_id", "start", "end", "alerts",
                          *[f"{e} AS {n}" for n, e in _LEG])
    return out.withColumn("cost", F.expr("CASE WHEN fuel_l <> 0 THEN fuel_l * price_fuel END"))


# -- the same views as SQL ------------------------------------------------------

def dec(x: str, digits: int) -> str:
    """Correctly rounded decimals (half to even on the exact binary value)."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


_L100 = "coalesce(nullif(l100km, 0), nullif(cloud_fuel_l, 0) / nullif(distance_km, 0) * 1e2)"

SQL = {
    "samples_v": ([], """
SELECT user_id AS vehicle_id,
       user_id * 10000 + CAST(floor(epoch_us(ts) / 1e6 / 604800e0) AS BIGINT) AS trip_id,
       event_id AS seq, epoch_us(ts) / 1e6 AS sec, event_type AS pid, value,
       CASE WHEN event_type IN ('error', 'signup') THEN '' ELSE 'u' END AS unit,
       CAST(k // 10 AS DOUBLE) AS lat, CAST(k % 10 AS DOUBLE) AS lon
FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events)"""),
    "win_v": (["samples_v"], """
SELECT trip_id,
       coalesce(min(sec) FILTER (pid = 'view'), min(sec) FILTER (pid = 'click'), min(sec)) AS t_start,
       coalesce(max(sec) FILTER (pid = 'view'), max(sec) FILTER (pid = 'click'), max(sec)) AS t_end
FROM samples_v GROUP BY trip_id"""),
    "clip_v": (["samples_v", "win_v"], """
SELECT s.*, t_start, t_end FROM samples_v s JOIN win_v w USING (trip_id)
WHERE sec BETWEEN t_start AND t_end"""),
    "trips_v": ([], f"""
SELECT *, CASE WHEN fuel_l > 0 AND distance_km > 0 THEN fuel_l / distance_km * 1e2 END AS l100km FROM (
SELECT o_custkey AS vehicle_id, o_orderkey AS trip_id, 'obd_csv' AS source,
       concat(strftime(start, '%Y-%m-%d %H-%M-%S'), '.csv') AS filename, start,
       start + to_seconds((qty % 200) * 86400 + 450)
             + to_milliseconds(CASE WHEN o_orderkey % 4 = 0 THEN 700 ELSE 0 END) AS "end",
       CASE WHEN o_orderkey % 6 = 0 AND smin IS NOT NULL
            THEN [CAST(smin % 168 AS INT), CAST(smax % 168 AS INT)] ELSE CAST([] AS INT[]) END AS alerts,
       {', '.join(f'{e} AS {n}' for n, e in _TRIP)}
FROM (SELECT *, o_orderdate + to_minutes(o_orderkey * 37 % 1440) AS start FROM orders LEFT JOIN (
        SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
               count(DISTINCT l_partkey) AS parts, min(l_suppkey) AS smin, max(l_suppkey) AS smax
        FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey))"""),
    "trips_p": (["trips_v"], f"""
SELECT * REPLACE (coalesce(nullif(fuel_l, 0), cloud_fuel_l) AS fuel_l,
                  {dec('nullif(' + _L100 + ', 0)', 2)} AS l100km,
                  coalesce(dpf_state, 'idle') AS dpf_state),
       CASE WHEN {_L100} > 0 THEN {dec('1e2 / ' + _L100, 2)} END AS kml,
       nullif(cloud_fuel_l, 0) * nullif(price_fuel, 0) AS cost,
       CASE WHEN cloud_id IS NULL THEN ['obd'] ELSE ['obd', 'myopel'] END AS sources
FROM trips_v"""),
    "legs_v": ([], f"""
SELECT *, CASE WHEN fuel_l <> 0 THEN fuel_l * price_fuel END AS cost FROM (
SELECT vehicle_id, leg_id, start, start + to_minutes(qty * 9) AS "end",
       CASE WHEN leg_id % 4 = 0 THEN CAST([] AS INT[]) ELSE [CAST(smin % 168 AS INT)] END AS alerts,
       {', '.join(f'{e} AS {n}' for n, e in _LEG)}
FROM (SELECT o_custkey AS vehicle_id, l_orderkey * 10 + l_linenumber AS leg_id,
             min(l_shipdate) + to_minutes(max(l_partkey) % 1440) AS start,
             CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
             min(l_suppkey) AS smin
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2))"""),
}


RECURSIVE: set[str] = set()


def add_view(name: str, needs: list[str], text: str, recursive: bool = False) -> None:
    SQL[name] = (needs, text)
    if recursive:
        RECURSIVE.add(name)


def with_views(text: str, *names: str, recursive: bool = False) -> str:
    """The query text behind the WITH clause of the views it needs."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for m in SQL[n][0]:
            visit(m)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    ctes = ", ".join(f"{n} AS ({SQL[n][1]})" for n in ordered)
    word = "WITH RECURSIVE" if recursive or any(n in RECURSIVE for n in ordered) else "WITH"
    body = text.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"{word} {ctes}, {body[5:]}"
    return f"{word} {ctes} {body}"
