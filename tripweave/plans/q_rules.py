"""Registered queries of the insight rules; texts are compared literally."""

from __future__ import annotations

from tripweave import fixed_values as fv
from tripweave.functions import km_per_l_of_trip
from tripweave.operators import rules as ru, trends as tr
from tripweave.plans import q_trips  # noqa: F401  (its views are used here)
from tripweave.plans import views as v
from tripweave.plans.registry import query
from tripweave.plans.views import add_view, dec

M, V = fv.TRIP_MESSAGES, fv.VEHICLE_MESSAGES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def msg(template: str, *args: str) -> str:
    if not args:
        return lit(template.replace("%%", "%"))
    return f"printf({lit(template)}, {', '.join(args)})"


# -- per trip --------------------------------------------------------------------

add_view("facts_v", ["trips_p", "economy_v"], f"""
SELECT t.*, coalesce(nullif(kml, 0), CASE WHEN l100km > 0 THEN {dec('1e2 / l100km', 2)} END,
    CASE WHEN fuel_l > 0 THEN {dec('nullif(distance_km, 0) / fuel_l', 2)} END) AS k, nullif(med, 0) AS med,
  coalesce(distance_km, 0) AS dist, coalesce(dpf_state, 'idle') AS state, exhaust_after_cat_c AS egt,
  dpf_closed_soot AS soot
FROM trips_p t LEFT JOIN (SELECT vehicle_id, {dec('median(economy)', 1)} AS med FROM economy_v GROUP BY 1) USING (vehicle_id)""")

_DELTA = "((k - med) / med * 100)"
_CMP = "med IS NOT NULL AND dist >= 3"
_WARM = f"CASE WHEN coolant_max_c >= 80 THEN {lit(M['cold_warmed'])} ELSE {lit(M['cold_not_warmed'])} END"
_ACTIVE = f"CASE WHEN egt <> 0 THEN {msg(M['regen_active_egt'], 'egt')} ELSE {lit(M['regen_active_no_egt'])} END"
_ASKED = f"CASE WHEN egt <> 0 THEN {msg(M['regen_requested_egt'], 'egt')} ELSE '' END"

# rule -> [(condition, category, level, title, body)], first match wins
TRIP_SQL = {
    "r_fuel": [
        (f"k IS NOT NULL AND NOT coalesce({_CMP}, false)", "fuel", "info", msg(M["fuel_plain"][0], "k"), msg(M["fuel_plain"][1], "1e2 / k")),
        (f"k IS NOT NULL AND {_DELTA} >= 12", "fuel", "info", msg(M["fuel_good"][0], "k"), msg(M["fuel_good"][1], f"abs({_DELTA})", "med")),
        (f"k IS NOT NULL AND {_DELTA} <= -18", "fuel", "warning", msg(M["fuel_bad"][0], "k"), msg(M["fuel_bad"][1], f"abs({_DELTA})", "med")),
        ("k IS NOT NULL", "fuel", "info", msg(M["fuel_normal"][0], "k"), msg(M["fuel_normal"][1], "med"))],
    "r_cold_start": [("air_temp_c < 18 AND coolant_max_c <> 0", "engine", "info", msg(M["cold_start"][0]),
                      msg(M["cold_start"][1], "air_temp_c", "coolant_max_c", _WARM))],
    "r_regen": [
        ("state = 'active'", "dpf", "info", msg(M["regen_active"][0]), msg(M["regen_active"][1], _ACTIVE)),
        ("state = 'completed'", "dpf", "info", msg(M["regen_completed"][0]), msg(M["regen_completed"][1])),
        ("state = 'requested' AND dist < 8", "dpf", "warning", msg(M["regen_short"][0]), msg(M["regen_short"][1])),
        ("state = 'requested'", "dpf", "warning", msg(M["regen_requested"][0]), msg(M["regen_requested"][1], _ASKED)),
        ("state = 'post_regen'", "dpf", "info", msg(M["regen_post"][0]), msg(M["regen_post"][1]))],
    "r_soot": [
        ("dist < 5 AND state IN ('idle', 'requested') AND soot >= 4", "dpf", "warning", msg(M["soot_short"][0]), msg(M["soot_short"][1], "dist", "soot")),
        ("soot >= 7", "dpf", "warning", msg(M["soot_high"][0], "soot"), msg(M["soot_high"][1]))],
    "r_egt": [("egt > 700 AND state NOT IN ('active', 'completed')", "engine", "info", msg(M["egt"][0], "egt"), msg(M["egt"][1]))],
    "r_oil": [("oil_dilution_pct > 5", "engine", "critical", msg(M["oil"][0], "oil_dilution_pct"), msg(M["oil"][1]))],
    "r_stopstart": [("ss_state = 7", "engine", "warning", msg(M["stop_start"][0]), msg(M["stop_start"][1]))],
}


def rule_sql(key: str, view: str, rows, ordinal: int) -> str:
    def case(i):
        return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]}" for r in rows) + " END"

    quoted = [(c, lit(cat), lev if " " in lev else lit(lev), t, b) for c, cat, lev, t, b in rows]
    rows = quoted
    return (f"SELECT {key}, {ordinal} AS rule, {case(1)} AS category, {case(2)} AS level, {case(3)} AS title, "
            f"{case(4)} AS body FROM {view} WHERE " + " OR ".join(f"coalesce({r[0]}, false)" for r in rows))


def _trip_rule(name, fn, i):
    @query(name, f"SELECT trip_id, category, level, title, body FROM ({rule_sql('trip_id', 'facts_v', TRIP_SQL[name], i)})",
           ("facts_v",))
    def run(spark, d):
        t = v.trips_read(spark, d)
        rows = t.join(tr.economy_context(t).select("vehicle_id", "median_kml"), "vehicle_id", "left")
        out = rows.withColumn("_kml", km_per_l_of_trip()).select("trip_id", fn().alias("i"))
        return out.filter("i is not null").select("trip_id", "i.*")

    return run


for _i, _fn in enumerate(ru.TRIP_RULES):
    _trip_rule(_fn.__name__, _fn, _i)

add_view("insights_v", ["facts_v"], """
SELECT trip_id, vehicle_id, start, row_number() OVER (PARTITION BY trip_id ORDER BY rule) - 1 AS ord, category, level, title, body
FROM (""" + " UNION ALL ".join(rule_sql("trip_id, vehicle_id, start", "facts_v", TRIP_SQL[n], i)
                              for i, n in enumerate(TRIP_SQL)) + ")")


def _insights(spark, d):
    rows = ru.recompute_insights(v.trips_read(spark, d))
    return rows, ru.explode_insights(rows, "trip_id", "vehicle_id", "start")


@query("recompute_insights", "SELECT trip_id, ord, category, level, title, body FROM insights_v", ("insights_v",))
def recompute_insights(spark, d):
    return _insights(spark, d)[1].select("trip_id", "ord", "category", "level", "title", "body")


@query("insight_trips", "SELECT DISTINCT trip_id FROM insights_v", ("insights_v",))
def insight_trips(spark, d):
    return ru.insight_trips(_insights(spark, d)[0]).select("trip_id")


@query("insights_by_level", "SELECT trip_id, ord, title FROM insights_v WHERE level = 'warning'", ("insights_v",))
def insights_by_level(spark, d):
    return ru.insights_by_level(_insights(spark, d)[1], "warning").select("trip_id", "ord", "title")


@query("insight_summary", """
SELECT vehicle_id, category, count(*) AS n, arg_max(title, (start, trip_id, ord)) FILTER (level = 'critical') AS latest_critical
FROM insights_v GROUP BY ALL""", ("insights_v",))
def insight_summary(spark, d):
    return ru.insight_summary(_insights(spark, d)[1])


# -- per vehicle -----------------------------------------------------------------

_KEY = "(start, trip_id)"


def _st(c: str, name: str) -> str:
    return f"{dec(c, 9)} AS {name}"


add_view("cost_std_v", ["trips_p"], f"""
SELECT vehicle_id, count(*) AS n, sum(cost) AS total, {dec('sum(cost)', 9)} / {dec('sum(distance_km)', 9)} * 100 AS per100,
  coalesce(sum(cost) FILTER (recent), 0) AS recent_cost, count(*) FILTER (recent) AS recent_n
FROM (SELECT *, floor((epoch(max(start) OVER (PARTITION BY vehicle_id)) - epoch(start)) / 86400e0) <= 30 AS recent
      FROM trips_p WHERE cost <> 0 AND distance_km <> 0) GROUP BY vehicle_id HAVING count(*) >= 4""")
add_view("vehicle_facts_v", ["trips_p", "eco_v", "cost_std_v", "battery_v"], f"""
SELECT a.*, e.n AS eco_n, e.best AS eco_best, {_st('e.median', 'eco_median')}, {_st('e.recent', 'eco_recent')},
  {_st('e.older', 'eco_older')}, concat(day(e.best_start), ' ', {q_trips._MONTHS}[month(e.best_start)]) AS eco_date,
  c.n AS cost_n, {_st('c.total', 'cost_total')}, {_st('c.per100', 'cost_per100')}, {_st('c.recent_cost', 'cost_recent')}, c.recent_n AS cost_recent_n,
  b.n AS bat_n, {_st('b.last', 'bat_last')}, {_st('b.median', 'bat_median')}, {_st('b.recent', 'bat_recent')}, {_st('b.older', 'bat_older')}
FROM (SELECT vehicle_id,
    arg_max(dpf_since_regen_km, {_KEY}) FILTER (dpf_since_regen_km IS NOT NULL) AS since,
    arg_max(dpf_avg_regen_km, {_KEY}) FILTER (dpf_avg_regen_km <> 0) AS avg_regen,
    arg_max(dpf_closed_soot, {_KEY}) FILTER (dpf_closed_soot IS NOT NULL) AS soot,
    arg_max(adblue_range_km, {_KEY}) FILTER (adblue_range_km IS NOT NULL) AS adblue,
    arg_max(oil_dilution_pct, {_KEY}) FILTER (oil_dilution_pct IS NOT NULL) AS oil_last,
    arg_min(oil_dilution_pct, {_KEY}) FILTER (oil_dilution_pct IS NOT NULL) AS oil_first,
    count(oil_dilution_pct) AS oil_n,
    arg_max(km_to_service, {_KEY}) FILTER (km_to_service IS NOT NULL) AS km,
    arg_max(days_to_service, {_KEY}) FILTER (days_to_service IS NOT NULL) AS days
  FROM trips_p GROUP BY vehicle_id) a
LEFT JOIN eco_v e USING (vehicle_id) LEFT JOIN cost_std_v c USING (vehicle_id) LEFT JOIN battery_v b USING (vehicle_id)""")

_PCT = "(since / avg_regen * 100)"
_WORSE, _BETTER = "eco_recent < eco_older * 0.9e0", "eco_recent > eco_older * 1.08e0"
_ECO = (f"concat({msg(V['economy'][1], 'eco_median', 'eco_n', 'eco_best', 'eco_date')}, CASE WHEN {_WORSE} THEN "
        f"{msg(V['economy_worse'], 'eco_recent', '(eco_older - eco_recent) / eco_older * 100', 'eco_older')} "
        f"WHEN {_BETTER} THEN {msg(V['economy_better'], 'eco_recent')} ELSE '' END)")
_COSTED = (f"concat({msg(V['cost'][1], 'cost_per100', 'cost_total', 'cost_n')}, CASE WHEN cost_recent_n > 0 THEN "
           f"{msg(V['cost_recent'], 'cost_recent', 'cost_recent_n')} ELSE '' END)")
_BAD_BAT = "(bat_recent < bat_older - 0.25e0 OR bat_median < 9.3e0)"
_OIL_BAD = "(oil_last > 5 OR (oil_n >= 3 AND oil_last > oil_first + 1))"
_D1 = f"CASE WHEN days <> 0 THEN {msg(V['service_due_days'], 'days')} ELSE '' END"
_D2 = f"CASE WHEN days <> 0 THEN {msg(V['service_ok_days'], 'days')} ELSE '' END"

VEHICLE_SQL = {
    "x_next_regen": [
        ("avg_regen > 20 AND avg_regen - since > 0", "dpf", f"CASE WHEN {_PCT} < 90 THEN 'info' ELSE 'warning' END",
         msg(V["next_regen"][0]), msg(V["next_regen"][1], "since", "avg_regen", _PCT, "avg_regen - since")),
        ("avg_regen > 20 AND since IS NOT NULL", "dpf", "warning", msg(V["regen_overdue"][0]), msg(V["regen_overdue"][1], "since", "avg_regen"))],
    "x_soot": [("soot >= 7", "dpf", "warning", msg(V["soot"], "soot"), lit(V["soot_high"])),
               ("soot < 7", "dpf", "info", msg(V["soot"], "soot"), lit(V["soot_normal"]))],
    "x_economy": [("eco_n >= 3", "fuel", f"CASE WHEN {_WORSE} THEN 'warning' ELSE 'info' END", msg(V["economy"][0]), _ECO)],
    "x_cost": [("cost_n >= 4", "fuel", "info", msg(V["cost"][0]), _COSTED)],
    "x_battery": [(f"bat_n >= 4 AND {_BAD_BAT}", "battery", "warning", msg(V["battery_bad"][0], "bat_last"), msg(V["battery_bad"][1], "bat_median")),
                  ("bat_n >= 4", "battery", "info", msg(V["battery_ok"][0], "bat_last"), msg(V["battery_ok"][1], "bat_median", "bat_n"))],
    "x_oil": [(_OIL_BAD, "engine", "warning", msg(V["oil"], "oil_last"), lit(V["oil_bad"])),
              ("oil_last IS NOT NULL", "engine", "info", msg(V["oil"], "oil_last"), lit(V["oil_ok"]))],
    "x_adblue": [("adblue < 1500", "adblue", "CASE WHEN adblue < 500 THEN 'critical' ELSE 'warning' END", msg(V["adblue"], "adblue"), lit(V["adblue_low"])),
                 ("adblue >= 1500", "adblue", "info", msg(V["adblue"], "adblue"), lit(V["adblue_ok"]))],
    "x_service": [("km < 1500 OR days < 30", "service", "CASE WHEN km <= 0 OR coalesce(nullif(days, 0), 99) <= 0 THEN 'critical' ELSE 'warning' END",
                   msg(V["service_due"][0]), msg(V["service_due"][1], "CAST(km AS DOUBLE)", _D1)),
                  ("km IS NOT NULL", "service", "info", msg(V["service_ok"][0]), msg(V["service_ok"][1], "CAST(km AS DOUBLE)", _D2))],
}


def _vehicle_rule(name, fn, i):
    @query(name, f"SELECT vehicle_id, category, level, title, body FROM ({rule_sql('vehicle_id', 'vehicle_facts_v', VEHICLE_SQL[name], i)})",
           ("vehicle_facts_v",))
    def run(spark, d):
        return ru.cross_trip_insights(v.trips_read(spark, d), (fn,)).drop("ord")

    return run


for _i, _fn in enumerate(ru.VEHICLE_RULES):
    _vehicle_rule(_fn.__name__, _fn, _i)


@query("cross_trip_insights", """
SELECT vehicle_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY rule) - 1 AS ord, category, level, title, body
FROM (""" + " UNION ALL ".join(rule_sql("vehicle_id", "vehicle_facts_v", VEHICLE_SQL[n], i)
                              for i, n in enumerate(VEHICLE_SQL)) + ")", ("vehicle_facts_v",))
def cross_trip_insights(spark, d):
    return ru.cross_trip_insights(v.trips_read(spark, d))


# -- threshold variants ----------------------------------------------------------

@query("rule_variants", """
SELECT trip_id, 'soot_pct' AS rule_id, CASE WHEN dpf_soot_pct >= 90 THEN 'critical' ELSE 'warning' END AS level, dpf_soot_pct AS value FROM trips_p WHERE dpf_soot_pct >= 70
UNION ALL SELECT trip_id, 'egt_spike', 'warning', exhaust_after_cat_c FROM trips_p WHERE exhaust_after_cat_c > 700
UNION ALL SELECT trip_id, 'oil_dilution', CASE WHEN oil_dilution_pct > 3 THEN 'critical' ELSE 'warning' END, oil_dilution_pct FROM trips_p WHERE oil_dilution_pct > 1.5
UNION ALL SELECT trip_id, 'stop_start', 'warning', ss_state FROM trips_p WHERE ss_state = 9
UNION ALL SELECT trip_id, 'oil_change', 'warning', km_to_oil_change FROM trips_p WHERE km_to_oil_change < 2000
UNION ALL SELECT trip_id, 'coolant_cold', 'info', coolant_first_c FROM trips_p WHERE coolant_first_c < 40""", ("trips_p",))
def rule_variants(spark, d):
    return ru.threshold_insights(v.trips_read(spark, d))


@query("regen_capability_drop", """
SELECT trip_id, dpf_regen_capability_st AS short_term, dpf_regen_capability AS long_term FROM trips_p
WHERE dpf_regen_capability_st < dpf_regen_capability * 0.5e0""", ("trips_p",))
def regen_capability_drop(spark, d):
    return ru.regen_capability_drop(v.trips_read(spark, d))


@query("regen_capability_drop_mock", """
SELECT trip_id, dpf_regen_capability_st AS short_term, dpf_regen_capability AS long_term FROM trips_p
WHERE dpf_regen_capability_st < dpf_regen_capability * 0.8e0""", ("trips_p",))
def regen_capability_drop_mock(spark, d):
    return ru.regen_capability_drop(v.trips_read(spark, d), 0.8)


def _context_sql(short, good):
    return f"""SELECT * FROM (SELECT trip_id, CASE WHEN distance_km < 5 AND l100km > {short} THEN 'short' WHEN l100km < {good} THEN 'excellent'
  WHEN l100km > 8 THEN 'high' END AS context, l100km FROM trips_p) WHERE context IS NOT NULL"""


@query("consumption_context", _context_sql("15e0", "4.5e0"), ("trips_p",))
def consumption_context(spark, d):
    return ru.consumption_context(v.trips_read(spark, d))


@query("consumption_context_mock", _context_sql("6.5e0", "4.7e0"), ("trips_p",))
def consumption_context_mock(spark, d):
    return ru.consumption_context(v.trips_read(spark, d), short_l100=6.5, good=4.7)


@query("dpf_alert_enrich", f"""
SELECT trip_id, CASE WHEN dpf_soot_pct <> 0 THEN {msg(fv.DPF_ALERT_CONFIRMED, 'dpf_soot_pct')}
  ELSE {lit(fv.DPF_ALERT_UNCONFIRMED)} END AS text FROM trips_p WHERE list_contains(alerts, 3)""", ("trips_p",))
def dpf_alert_enrich(spark, d):
    return ru.dpf_alert_enrich(v.trips_read(spark, d), 3)
