"""Registered queries of the reconciliation: overlaps, chains, sessions, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.operators import reconcile as rc
from tripweave.plans import views as v
from tripweave.plans.q_trips import dst_sql
from tripweave.plans.registry import query, r6, s6
from tripweave.plans.views import add_view, dec

DAY = 86_400.0
GAP_S = 20 * DAY          # the orders of a customer lie months apart, so gaps are given in days
MATCH_S = 20 * DAY
DEDUPE_S = 30 * DAY
BUCKET_S = 10 * DAY
NEAREST_S = 15 * DAY

# -- overlaps --------------------------------------------------------------------

add_view("ranked_v", ["trips_v"], """
SELECT vehicle_id, trip_id, floor(epoch(start)) AS s, floor(epoch("end")) AS e, coalesce(pid_count, 0) AS n,
       coalesce(duration_min, 0) AS d,
       row_number() OVER (PARTITION BY vehicle_id ORDER BY start, trip_id) AS rn FROM trips_v""")
add_view("champion_v", ["ranked_v"], """
SELECT vehicle_id, rn, trip_id AS c, e AS ce, n AS cn, d AS cd, CAST(NULL AS BIGINT) AS loser,
       CAST(NULL AS BIGINT) AS winner FROM ranked_v WHERE rn = 1
UNION ALL
SELECT vehicle_id, rn, CASE WHEN fresh OR richer THEN trip_id ELSE c END,
       CASE WHEN fresh OR richer THEN e ELSE ce END, CASE WHEN fresh OR richer THEN n ELSE cn END,
       CASE WHEN fresh OR richer THEN d ELSE cd END,
       CASE WHEN fresh THEN NULL WHEN richer THEN c ELSE trip_id END,
       CASE WHEN fresh THEN NULL WHEN richer THEN trip_id ELSE c END
FROM (SELECT r.*, k.c, k.ce, k.cn, k.cd, k.ce IS NULL OR r.s >= k.ce AS fresh,
             r.n > k.cn OR (r.n = k.cn AND r.d > k.cd) AS richer
      FROM champion_v k JOIN ranked_v r ON r.vehicle_id = k.vehicle_id AND r.rn = k.rn + 1)""", recursive=True)
add_view("removed_v", ["champion_v"],
         "SELECT vehicle_id, loser AS trip_id, winner AS winner_id FROM champion_v WHERE loser IS NOT NULL")


@query("overlap_dedup", "SELECT * FROM removed_v", ("removed_v",))
def overlap_dedup(spark, d):
    return rc.overlap_dedup(v.trips(spark, d)).select("vehicle_id", "trip_id", "winner_id")


@query("overlap_self_join", """
SELECT a.vehicle_id, a.trip_id AS trip_a, b.trip_id AS trip_b FROM ranked_v a JOIN ranked_v b
ON a.vehicle_id = b.vehicle_id AND b.rn > a.rn AND b.s < a.e""", ("ranked_v",))
def overlap_self_join(spark, d):
    return rc.overlap_pairs(v.trips(spark, d), BUCKET_S)


@query("absorbed_except", "SELECT trip_id FROM trips_v WHERE trip_id NOT IN (SELECT trip_id FROM removed_v)",
       ("trips_v", "removed_v"))
def absorbed_except(spark, d):
    t = v.trips(spark, d)
    return rc.absorbed_except(t, rc.overlap_dedup(t)).select("trip_id")


# -- chains ----------------------------------------------------------------------

def _chains(name: str, source: str) -> None:
    add_view(name, [source], f"""
SELECT vehicle_id, trip_id, start, first_value(trip_id) OVER c AS primary_id, count(*) OVER g AS members
FROM (SELECT *, sum(opens) OVER w AS chain FROM (
  SELECT *, CASE WHEN floor(epoch(start)) - floor(epoch(lag("end") OVER w)) BETWEEN 0 AND {GAP_S} THEN 0 ELSE 1 END AS opens
  FROM {source} WINDOW w AS (PARTITION BY vehicle_id ORDER BY start, trip_id))
  WINDOW w AS (PARTITION BY vehicle_id ORDER BY start, trip_id))
WINDOW c AS (PARTITION BY vehicle_id, chain ORDER BY start, trip_id), g AS (PARTITION BY vehicle_id, chain)""")


def _merged(name: str, source: str, chains: str) -> None:
    dist, fuel, dur = "nullif(dist, 0)", "nullif(fuel, 0)", "nullif(dur, 0)"
    add_view(name, [source, chains], f"""
SELECT t.* REPLACE (CASE WHEN n > 1 THEN m_end ELSE t."end" END AS "end",
    CASE WHEN n > 1 THEN {dur} ELSE duration_min END AS duration_min,
    CASE WHEN n > 1 THEN {dist} ELSE distance_km END AS distance_km,
    CASE WHEN n > 1 THEN {fuel} ELSE fuel_l END AS fuel_l,
    CASE WHEN n > 1 THEN m_max ELSE max_speed_kmh END AS max_speed_kmh,
    CASE WHEN n > 1 THEN coalesce({dist} / ({dur} / 60e0), avg_speed_kmh) ELSE avg_speed_kmh END AS avg_speed_kmh,
    CASE WHEN n > 1 THEN coalesce({fuel} / {dist} * 100, l100km) ELSE l100km END AS l100km,
    CASE WHEN n > 1 THEN m_cloud ELSE cloud_id END AS cloud_id, CASE WHEN n > 1 THEN m_vin ELSE vin END AS vin,
    CASE WHEN n > 1 THEN m_alerts ELSE alerts END AS alerts), n AS merged
FROM {source} t JOIN (
  SELECT primary_id, count(*) AS n, max("end") AS m_end, sum(duration_min) AS dur, sum(distance_km) AS dist,
         sum(fuel_l) AS fuel, max(max_speed_kmh) AS m_max,
         arg_min(cloud_id, (s.start, s.trip_id)) FILTER (cloud_id <> 0) AS m_cloud,
         arg_min(vin, (s.start, s.trip_id)) FILTER (vin <> '') AS m_vin,
         list_sort(list_distinct(flatten(list(alerts)))) AS m_alerts
  FROM {source} s JOIN {chains} USING (trip_id) GROUP BY primary_id) ON primary_id = t.trip_id""")


_chains("chains_v", "trips_v")
_merged("merged_trips_v", "trips_v", "chains_v")
_MERGED = ["duration_min", "distance_km", "fuel_l", "l100km", "avg_speed_kmh", "max_speed_kmh"]


@query("obd_chains", "SELECT vehicle_id, trip_id, primary_id, members FROM chains_v", ("chains_v",))
def obd_chains(spark, d):
    return rc.sensor_chains(v.trips(spark, d), GAP_S).select("vehicle_id", "trip_id", "primary_id", "members")


@query("merge_trips", f"""
SELECT trip_id, "end", cloud_id, vin, merged, array_to_string(alerts, ',') AS alerts, {', '.join(s6(c) for c in _MERGED)}
FROM merged_trips_v""", ("merged_trips_v",))
def merge_trips(spark, d):
    t = v.trips(spark, d)
    out = rc.merge_trips(t, rc.sensor_chains(t, GAP_S))
    return out.select("trip_id", "end", "cloud_id", "vin", "merged",
                      F.array_join(F.col("alerts").cast("array<string>"), ",").alias("alerts"),
                      *[r6(c) for c in _MERGED])


@query("merged_ids", """
SELECT primary_id, array_to_string(list(trip_id ORDER BY start, trip_id), ',') AS merged_ids FROM chains_v
GROUP BY primary_id""", ("chains_v",))
def merged_ids(spark, d):
    t = v.trips(spark, d)
    out = rc.merge_trips(t, rc.sensor_chains(t, GAP_S), nested_ids=True)
    return out.select(F.col("trip_id").alias("primary_id"),
                      F.array_join(F.col("merged_ids").cast("array<string>"), ",").alias("merged_ids"))


add_view("points_v", ["legs_v"], """
SELECT leg_id // 10 AS trip_id, row_number() OVER (PARTITION BY leg_id // 10 ORDER BY leg_id) - 1 AS idx,
       distance_km AS lat, duration_min AS lon FROM legs_v""")


@query("tracks_concat", """
SELECT primary_id AS trip_id, row_number() OVER (PARTITION BY primary_id ORDER BY start, c.trip_id, idx) - 1 AS idx,
       lat, lon FROM points_v p JOIN chains_v c ON c.trip_id = p.trip_id""", ("points_v", "chains_v"))
def tracks_concat(spark, d):
    from tripweave.operators import ordered as o

    legs = v.legs(spark, d).select(F.expr("leg_id div 10").alias("trip_id"), "leg_id",
                                   F.col("distance_km").alias("lat"), F.col("duration_min").alias("lon"))
    points = o.ordered_scan(legs, ["trip_id"], ["leg_id"], o.chunk_by_sequence("leg_id"), pos=o.position())
    points = points.select("trip_id", (F.col("pos") - 1).alias("idx"), "lat", "lon")
    return rc.tracks_concat(points, rc.sensor_chains(v.trips(spark, d), GAP_S))


# -- sessions --------------------------------------------------------------------

def _sessions(name: str, legs: str, trips: str) -> None:
    add_view(name, [legs, trips], f"""
SELECT l.vehicle_id, leg_id, arg_max(t.trip_id, (t.start, -t.trip_id)) AS trip_id
FROM (SELECT *, epoch(start) AS a, epoch(start) - {dst_sql('start')} AS b FROM {legs}) l
JOIN {trips} t ON t.vehicle_id = l.vehicle_id AND coalesce(t.distance_km, 0) >= 0.5
 AND (a BETWEEN epoch(t.start) - 360 AND epoch(t."end") + 360 OR b BETWEEN epoch(t.start) - 360 AND epoch(t."end") + 360)
GROUP BY ALL""")


_sessions("assigned_v", "legs_v", "trips_v")


def _assigned(spark, d):
    return rc.leg_session_join(v.legs(spark, d), rc.session_min_filter(v.trips(spark, d)), bucket_s=BUCKET_S)


def _placed(spark, d):
    return rc.place_legs(v.legs(spark, d), rc.session_min_filter(v.trips(spark, d)), bucket_s=BUCKET_S)


@query("leg_session_join", "SELECT * FROM assigned_v", ("assigned_v",))
def leg_session_join(spark, d):
    return _assigned(spark, d)


def _aggregate(name: str, assigned: str) -> None:
    add_view(name, [assigned, "legs_v"], f"""
SELECT a.trip_id, count(*) AS legs, arg_min(leg_id, (start, leg_id)) AS cloud_id,
  nullif(sum(coalesce(fuel_l, 0)), 0) AS cloud_fuel_l, nullif(sum(coalesce(distance_km, 0)), 0) AS cloud_distance_km,
  coalesce(nullif({dec('sum(coalesce(cost, 0))', 9)}, 0) / nullif({dec('sum(coalesce(fuel_l, 0))', 9)}, 0),
           nullif(arg_max(coalesce(price_fuel, 0), (start, leg_id)), 0)) AS price_fuel,
  arg_max(fuel_level, (start, leg_id)) AS fuel_level, arg_max(km_to_service, (start, leg_id)) AS km_to_service,
  arg_max(days_to_service, (start, leg_id)) AS days_to_service, bool_or(maintenance_passed) AS maintenance_passed,
  arg_min(vin, (start, leg_id)) FILTER (vin IS NOT NULL) AS vin,
  list_sort(list_distinct(flatten(list(alerts)))) AS alerts
FROM {assigned} a JOIN legs_v USING (leg_id) GROUP BY a.trip_id""")


_aggregate("enrichment_v", "assigned_v")
_AGG = ["cloud_fuel_l", "cloud_distance_km", "price_fuel"]


@query("leg_aggregate", f"""
SELECT trip_id, legs, cloud_id, fuel_level, km_to_service, days_to_service, maintenance_passed, vin,
  array_to_string(alerts, ',') AS alerts, {', '.join(s6(c) for c in _AGG)} FROM enrichment_v""", ("enrichment_v",))
def leg_aggregate(spark, d):
    out = rc.session_totals(_placed(spark, d), rounded=False)
    return out.select("trip_id", "legs", "cloud_id", "fuel_level", "km_to_service", "days_to_service",
                      "maintenance_passed", "vin",
                      F.array_join(F.col("alerts").cast("array<string>"), ",").alias("alerts"),
                      *[r6(c) for c in _AGG])


@query("enrich_update", f"""
SELECT t.trip_id, CASE WHEN e.trip_id IS NULL THEN t.cloud_id ELSE e.cloud_id END AS cloud_id,
  {s6('CASE WHEN e.trip_id IS NULL THEN t.cloud_fuel_l ELSE e.cloud_fuel_l END', 'cloud_fuel_l')},
  CASE WHEN e.trip_id IS NULL THEN t.fuel_level ELSE e.fuel_level END AS fuel_level, coalesce(t.vin, e.vin) AS vin,
  CASE WHEN e.trip_id IS NULL THEN len(t.alerts) ELSE len(e.alerts) END AS n_alerts
FROM trips_v t LEFT JOIN enrichment_v e USING (trip_id)""", ("trips_v", "enrichment_v"))
def enrich_update(spark, d):
    agg = rc.session_totals(_placed(spark, d), rounded=False)
    out = rc.enrich_update(v.trips(spark, d), agg)
    return out.select("trip_id", "cloud_id", r6("cloud_fuel_l"), "fuel_level", "vin",
                      F.size("alerts").alias("n_alerts"))


@query("standalone_anti", "SELECT leg_id FROM legs_v WHERE leg_id NOT IN (SELECT leg_id FROM assigned_v)",
       ("legs_v", "assigned_v"))
def standalone_anti(spark, d):
    return rc.standalone_anti(v.legs(spark, d), _assigned(spark, d), "leg_id").select("leg_id")


# -- scored candidates -----------------------------------------------------------

def _time(c: str) -> str:
    return f"CASE WHEN abs(ta - {c}) > {MATCH_S} THEN 0e0 ELSE 1e0 - abs(ta - {c}) / {MATCH_S} END"


add_view("scored_v", ["trips_v", "legs_v"], f"""
SELECT vehicle_id, trip_id, leg_id, 0.40e0 * ts + 0.50e0 * ds + 0.10e0 * ms AS score FROM (
  SELECT *, CASE WHEN dst - raw >= 0.30 AND raw < 0.90 THEN dst ELSE raw END AS ts,
    CASE WHEN da > 0 AND db > 0 THEN CASE WHEN abs(da - db) / greatest(da, db) > 0.3 THEN NULL
         ELSE 1e0 - abs(da - db) / greatest(da, db) / 0.3e0 END ELSE 0.5e0 END AS ds,
    CASE WHEN ma > 0 AND mb > 0 THEN greatest(0, 1e0 - abs(ma - mb) / greatest(ma, mb)) ELSE 0.5e0 END AS ms
  FROM (SELECT *, {_time('tb')} AS raw, {_time('td')} AS dst FROM (
    SELECT t.vehicle_id, trip_id, leg_id, epoch(t.start) AS ta, epoch(l.start) AS tb,
           epoch(l.start) - {dst_sql('l.start')} AS td, coalesce(t.distance_km, 0) AS da,
           coalesce(l.distance_km, 0) AS db, coalesce(t.duration_min, 0) AS ma, coalesce(l.duration_min, 0) AS mb
    FROM trips_v t JOIN legs_v l ON t.vehicle_id = l.vehicle_id)))
WHERE ts > 0 AND ds IS NOT NULL AND 0.40e0 * ts + 0.50e0 * ds + 0.10e0 * ms >= 0.25""")


def _scored(spark, d):
    return rc.match_score_join(v.trips(spark, d), v.legs(spark, d), MATCH_S)


@query("match_score_join", f"SELECT vehicle_id, trip_id, leg_id, {s6('score')}, score >= 0.5 AS would_correlate FROM scored_v",
       ("scored_v",))
def match_score_join(spark, d):
    return _scored(spark, d).select("vehicle_id", "trip_id", "leg_id", r6("score"), "would_correlate")


@query("candidates_by_score", f"SELECT trip_id, leg_id, {s6('score')} FROM scored_v ORDER BY score DESC, 1, 2", ("scored_v",))
def candidates_by_score(spark, d):
    return rc.candidates_by_score(_scored(spark, d)).select("trip_id", "leg_id", r6("score"))


@query("uncorrelated_report", """
SELECT vehicle_id, coalesce(a, 0) AS standalone_sensor, coalesce(b, 0) AS standalone_cloud, coalesce(c, 0) AS candidates
FROM (SELECT vehicle_id, count(*) AS a FROM trips_v GROUP BY 1)
FULL JOIN (SELECT vehicle_id, count(*) AS b FROM legs_v GROUP BY 1) USING (vehicle_id)
FULL JOIN (SELECT vehicle_id, count(*) AS c FROM scored_v GROUP BY 1) USING (vehicle_id)""", ("scored_v",))
def uncorrelated_report(spark, d):
    return rc.uncorrelated_report(v.trips(spark, d), v.legs(spark, d), _scored(spark, d))


# -- duplicate legs --------------------------------------------------------------

def _dups(name: str, legs: str) -> None:
    row = "{'id': leg_id, 's': s, 'd': d}"
    add_view(f"{name}_rank_v", [legs], f"""
SELECT vehicle_id, leg_id, epoch(start) AS s, coalesce(distance_km, 0) AS d,
       row_number() OVER (PARTITION BY vehicle_id ORDER BY start, leg_id) AS rn FROM {legs}""")
    add_view(f"{name}_step_v", [f"{name}_rank_v"], f"""
SELECT vehicle_id, rn, leg_id, [{row}] AS kept, CAST(NULL AS BIGINT) AS kept_id FROM {name}_rank_v WHERE rn = 1
UNION ALL
SELECT vehicle_id, rn, leg_id, CASE WHEN m IS NULL THEN list_append(near, {row}) ELSE near END, m FROM (
  SELECT *, list_filter(near, lambda k: NOT (k.d > 0 AND x_d > 0 AND abs(k.d - x_d) / greatest(k.d, x_d) > 0.1))[1].id AS m
  FROM (SELECT r.*, r.d AS x_d, list_filter(p.kept, lambda k: r.s - k.s <= {DEDUPE_S}) AS near
        FROM {name}_step_v p JOIN {name}_rank_v r ON r.vehicle_id = p.vehicle_id AND r.rn = p.rn + 1))""", recursive=True)
    add_view(name, [f"{name}_step_v"],
             f"SELECT vehicle_id, leg_id, kept_id FROM {name}_step_v WHERE kept_id IS NOT NULL")


_dups("dups_v", "legs_v")


@query("leg_dedup", "SELECT * FROM dups_v", ("dups_v",))
def leg_dedup(spark, d):
    return rc.leg_dedup(v.legs(spark, d), DEDUPE_S)


# -- nearest one-to-one ----------------------------------------------------------

add_view("cand_v", ["trips_v", "legs_v"], f"""
SELECT t.vehicle_id, t.trip_id, t.start, any_value(r) AS rn,
       list({{'leg': leg_id, 'delta': delta}} ORDER BY delta, l.t, CAST(leg_id AS VARCHAR)) FILTER (leg_id IS NOT NULL) AS cands
FROM (SELECT vehicle_id, trip_id, start, epoch(start) AS t, coalesce(distance_km, 0) AS d,
             row_number() OVER (PARTITION BY vehicle_id ORDER BY start, CAST(trip_id AS VARCHAR)) AS r FROM trips_v) t
LEFT JOIN LATERAL (SELECT leg_id, epoch(start) - 3600 AS t, abs(t.t - (epoch(start) - 3600)) AS delta FROM legs_v g
  WHERE g.vehicle_id = t.vehicle_id AND abs(t.t - (epoch(g.start) - 3600)) <= {NEAREST_S}
    AND (t.d = 0 OR coalesce(g.distance_km, 0) = 0 OR abs(t.d - g.distance_km) / greatest(t.d, 0.01) <= 0.2)) l ON true
GROUP BY t.vehicle_id, t.trip_id, t.start""")
add_view("taken_v", ["cand_v"], """
SELECT vehicle_id, rn, trip_id, cands[1] AS pick, [cands[1].leg] AS used FROM cand_v WHERE rn = 1
UNION ALL
SELECT vehicle_id, rn, trip_id, p, list_append(used, p.leg) FROM (
  SELECT c.*, t.used, list_filter(c.cands, lambda x: NOT coalesce(list_contains(t.used, x.leg), false))[1] AS p
  FROM taken_v t JOIN cand_v c ON c.vehicle_id = t.vehicle_id AND c.rn = t.rn + 1)""", recursive=True)
add_view("paired_v", ["taken_v", "legs_v"], """
SELECT vehicle_id, CAST(trip_id AS VARCHAR) AS trip_id, CAST(pick.leg AS VARCHAR) AS leg_id,
       CAST(pick.delta AS DOUBLE) AS delta_s,
       CASE WHEN pick.leg IS NULL THEN 'none' WHEN pick.delta <= 259200 THEN 'high' ELSE 'low' END AS confidence
FROM taken_v
UNION ALL SELECT vehicle_id, NULL, CAST(leg_id AS VARCHAR), NULL, 'none' FROM legs_v
WHERE leg_id NOT IN (SELECT pick.leg FROM taken_v WHERE pick.leg IS NOT NULL)""")


def _nearest(spark, d):
    return rc.correlate_nearest(v.trips(spark, d), v.legs(spark, d), window_s=NEAREST_S, high_s=3 * DAY)


@query("correlate_nearest", "SELECT trip_id, leg_id, delta_s, confidence FROM paired_v WHERE trip_id IS NOT NULL",
       ("paired_v",))
def correlate_nearest(spark, d):
    return _nearest(spark, d).filter("trip_id is not null").select("trip_id", "leg_id", "delta_s", "confidence")


@query("unmatched_union", "SELECT * FROM paired_v", ("paired_v",))
def unmatched_union(spark, d):
    return _nearest(spark, d)


@query("source_cross_check", f"""
SELECT t.trip_id, abs(t.fuel_l - e.cloud_fuel_l) / e.cloud_fuel_l <= 0.15 AS fuel_agrees,
  {s6('t.distance_km - e.cloud_distance_km', 'distance_diff_km')},
  CAST(epoch(t.start) - epoch(l.start) AS DOUBLE) AS departure_diff_s
FROM trips_v t JOIN enrichment_v e USING (trip_id) JOIN legs_v l ON l.leg_id = e.cloud_id""",
       ("trips_v", "enrichment_v", "legs_v"))
def source_cross_check(spark, d):
    legs = v.legs(spark, d)
    agg = rc.session_totals(_placed(spark, d), rounded=False)
    first = legs.select(F.col("leg_id").alias("cloud_id"), F.col("start").alias("cloud_start"))
    rows = (v.trips(spark, d).select("trip_id", "start", "fuel_l", "distance_km")
            .join(agg.select("trip_id", "cloud_id", "cloud_fuel_l", "cloud_distance_km"), "trip_id")
            .join(first, "cloud_id"))
    return rc.source_cross_check(rows).select("trip_id", "fuel_agrees", r6("distance_diff_km"), "departure_diff_s")


# -- the whole pass --------------------------------------------------------------

add_view("kept_v", ["trips_v", "removed_v"],
         "SELECT * FROM trips_v WHERE trip_id NOT IN (SELECT trip_id FROM removed_v)")
_chains("kept_chains_v", "kept_v")
_merged("gold_v", "kept_v", "kept_chains_v")
_sessions("gold_legs_v", "legs_v", "gold_v")
_aggregate("gold_agg_v", "gold_legs_v")
add_view("free_v", ["legs_v", "gold_legs_v"],
         "SELECT * FROM legs_v WHERE leg_id NOT IN (SELECT leg_id FROM gold_legs_v)")
_dups("gold_dups_v", "free_v")


#: columns of the results that aren't read by the decisions
GOLD_TRIPS = [*rc.DECIDING_TRIPS, "cloud_id", "cloud_fuel_l", "vin", "alerts"]
GOLD_LEGS = [*rc.DECIDING_LEGS, "fuel_l", "price_fuel", "vin", "alerts"]


def _reconciled(spark, d):
    return rc.reconcile(v.trips(spark, d).select(*GOLD_TRIPS), v.legs(spark, d).select(*GOLD_LEGS), gap_s=GAP_S, dedupe_s=DEDUPE_S, bucket_s=BUCKET_S)


def _decided(spark, d):
    return rc.decide(v.trips(spark, d), v.legs(spark, d), gap_s=GAP_S, dedupe_s=DEDUPE_S, bucket_s=BUCKET_S)


@query("reconcile", f"""
SELECT t.trip_id, t."end", {s6('t.distance_km', 'distance_km')}, t.merged,
  CASE WHEN e.trip_id IS NULL THEN t.cloud_id ELSE e.cloud_id END AS cloud_id,
  {dec('CASE WHEN e.trip_id IS NULL THEN t.cloud_fuel_l ELSE ' + dec('e.cloud_fuel_l', 3) + ' END', 6)} AS cloud_fuel_l,
  coalesce(t.vin, e.vin) AS vin,
  CASE WHEN e.trip_id IS NULL THEN len(t.alerts) ELSE len(e.alerts) END AS n_alerts
FROM gold_v t LEFT JOIN gold_agg_v e USING (trip_id)""", ("gold_v", "gold_agg_v"))
def reconcile(spark, d):
    return _reconciled(spark, d).trips.select(
        "trip_id", "end", r6("distance_km"), "merged", "cloud_id", r6("cloud_fuel_l"), "vin",
        F.size("alerts").alias("n_alerts"))


@query("reconcile_legs", "SELECT leg_id FROM free_v WHERE leg_id NOT IN (SELECT leg_id FROM gold_dups_v)",
       ("free_v", "gold_dups_v"))
def reconcile_legs(spark, d):
    return _decided(spark, d).legs.select("leg_id")


@query("correlation_counts", """
SELECT vehicle_id, 'overlaps_removed' AS counter, count(*) AS n FROM removed_v GROUP BY 1
UNION ALL SELECT vehicle_id, 'chains_merged', count(*) FILTER (trip_id = primary_id) FROM kept_chains_v WHERE members > 1 GROUP BY 1
UNION ALL SELECT vehicle_id, 'trips_absorbed', count(*) FILTER (trip_id <> primary_id) FROM kept_chains_v WHERE members > 1 GROUP BY 1
UNION ALL SELECT vehicle_id, 'sessions_correlated', count(DISTINCT trip_id) FROM gold_legs_v GROUP BY 1
UNION ALL SELECT vehicle_id, 'legs_absorbed', count(*) FROM gold_legs_v GROUP BY 1
UNION ALL SELECT vehicle_id, 'duplicates_removed', count(*) FROM gold_dups_v GROUP BY 1""",
       ("removed_v", "kept_chains_v", "gold_legs_v", "gold_dups_v"))
def correlation_counts(spark, d):
    return rc.correlation_counts(_decided(spark, d)).select("vehicle_id", "counter", "n")
