"""Insight rules: one row of facts in, an array of (category, level, title, body) out.

Every rule is a ``when`` expression over columns of the trip or vehicle row, so
all rules of a row run in one pass inside generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tripweave import fixed_values as fv
from tripweave.functions import fixed, km_per_l_of_trip, nonzero, settled
from tripweave.operators import trends as tr
from tripweave.operators.trips import is_sensor

M, V = fv.TRIP_MESSAGES, fv.VEHICLE_MESSAGES
_SPEC = re.compile(r"%(?:\.(\d)f|d|s)")


def message(template: str, *args: Column) -> Column:
    """Fill a printf-like template; decimals are rounded half to even, exactly."""
    values, rest = [], iter(args)
    for spec in _SPEC.finditer(template.replace("%%", "\0")):
        c = next(rest)
        values.append(fixed(c, int(spec.group(1))) if spec.group(1) else c.cast("string"))
    text = _SPEC.sub("%s", template.replace("%%", "\0")).replace("\0", "%%")
    return F.format_string(text, *values)


def insight(category: str, level, title: Column, body: Column) -> Column:
    level = F.lit(level) if isinstance(level, str) else level
    return F.struct(F.lit(category).alias("category"), level.alias("level"),
                    title.alias("title"), body.alias("body"))


def _plain(pair) -> tuple[Column, Column]:
    return message(pair[0]), message(pair[1])


# -- per trip ------------------------------------------------------------------

def r_fuel() -> Column:
    k, med = F.col("_kml"), nonzero("median_kml")
    delta = (k - med) / med * 100.0
    compare = med.isNotNull() & (F.coalesce(F.col("distance_km"), F.lit(0.0)) >= 3)

    def make(level, name, title_args, body_args):
        return insight("fuel", level, message(M[name][0], *title_args), message(M[name][1], *body_args))

    return (F.when(k.isNull(), None)
            .when(~compare, make("info", "fuel_plain", [k], [F.lit(100.0) / k]))
            .when(delta >= 12, make("info", "fuel_good", [k], [F.abs(delta), med]))
            .when(delta <= -18, make("warning", "fuel_bad", [k], [F.abs(delta), med]))
            .otherwise(make("info", "fuel_normal", [k], [med])))


def r_cold_start() -> Column:
    warm = F.when(F.col("coolant_max_c") >= 80, F.lit(M["cold_warmed"])).otherwise(
        F.lit(M["cold_not_warmed"]))
    hit = is_sensor() & (F.col("air_temp_c") < 18) & (F.col("coolant_max_c") != 0)
    return F.when(hit, insight("engine", "info", message(M["cold_start"][0]),
                               message(M["cold_start"][1], F.col("air_temp_c"),
                                       F.col("coolant_max_c"), warm)))


def _state() -> Column:
    return F.coalesce(F.when(F.col("dpf_state") != "", F.col("dpf_state")), F.lit("idle"))


def r_regen() -> Column:
    state, egt = _state(), F.col("exhaust_after_cat_c")
    shown = F.coalesce(egt != 0, F.lit(False))
    active = F.when(shown, message(M["regen_active_egt"], egt)).otherwise(
        F.lit(M["regen_active_no_egt"]))
    asked = F.when(shown, message(M["regen_requested_egt"], egt)).otherwise(F.lit(""))
    short = F.coalesce(F.col("distance_km"), F.lit(0.0)) < 8
    return (F.when(~is_sensor(), None)
            .when(state == "active", insight("dpf", "info", message(M["regen_active"][0]),
                                             message(M["regen_active"][1], active)))
            .when(state == "completed", insight("dpf", "info", *_plain(M["regen_completed"])))
            .when((state == "requested") & short, insight("dpf", "warning", *_plain(M["regen_short"])))
            .when(state == "requested", insight("dpf", "warning", message(M["regen_requested"][0]),
                                                message(M["regen_requested"][1], asked)))
            .when(state == "post_regen", insight("dpf", "info", *_plain(M["regen_post"]))))


def r_soot() -> Column:
    soot, dist = F.col("dpf_closed_soot"), F.coalesce(F.col("distance_km"), F.lit(0.0))
    short = (dist < 5) & _state().isin("idle", "requested") & (soot >= 4)
    return (F.when(~is_sensor(), None)
            .when(short, insight("dpf", "warning", message(M["soot_short"][0]),
                                 message(M["soot_short"][1], dist, soot)))
            .when(soot >= 7, insight("dpf", "warning", message(M["soot_high"][0], soot),
                                     message(M["soot_high"][1]))))


def r_egt(limit: float = 700.0) -> Column:
    egt = F.col("exhaust_after_cat_c")
    hit = is_sensor() & (egt > limit) & ~_state().isin("active", "completed")
    return F.when(hit, insight("engine", "info", message(M["egt"][0], egt), message(M["egt"][1])))


def r_oil(limit: float = 5.0) -> Column:
    d = F.col("oil_dilution_pct")
    return F.when(is_sensor() & (d > limit), insight("engine", "critical", message(M["oil"][0], d),
                                                     message(M["oil"][1])))


def r_stopstart(fault_state: int = 7) -> Column:
    return F.when(is_sensor() & (F.col("ss_state") == fault_state),
                  insight("engine", "warning", *_plain(M["stop_start"])))


TRIP_RULES = [r_fuel, r_cold_start, r_regen, r_soot, r_egt, r_oil, r_stopstart]


def per_trip_insights(trips: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Trips with an ``insights`` array.  ``context`` is (vehicle_id, median_kml)."""
    if context is None:
        context = tr.economy_context(trips)
    rows = trips.join(context.select("vehicle_id", "median_kml"), "vehicle_id", "left")
    rows = rows.withColumn("_kml", km_per_l_of_trip())
    return (rows.withColumn("insights", F.array_compact(F.array(*[r() for r in TRIP_RULES])))
            .drop("_kml", "median_kml"))


def recompute_insights(trips: DataFrame) -> DataFrame:
    """Insights of sensor trips only, as (trip_id, insights)."""
    out = per_trip_insights(trips)
    return out.filter(is_sensor()).select("vehicle_id", "trip_id", "start", "insights")


def explode_insights(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode("insights").alias("ord", "i")).select(*keys, "ord", "i.*")


def insight_trips(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("insights") > 0)


def insights_by_level(insights: DataFrame, level: str) -> DataFrame:
    return insights.filter(F.col("level") == level)


def insight_summary(insights: DataFrame) -> DataFrame:
    """Per vehicle and category: count and the latest critical title."""
    key = F.when(F.col("level") == "critical", F.struct("start", "trip_id", "ord"))
    return insights.groupBy("vehicle_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("title", key).alias("latest_critical"))


# -- per vehicle ---------------------------------------------------------------

def stable(c: str, kind: str) -> Column:
    return settled(c) if kind == "double" else F.col(c)


#: the columns the trend rules read
_FACTS = {"source", "sources", "dpf_since_regen_km", "dpf_avg_regen_km", "dpf_closed_soot", "adblue_range_km", "oil_dilution_pct",
          "km_to_service", "days_to_service", "battery_startup_v", "cost", "distance_km", "kml", "l100km", "fuel_l"}


def vehicle_facts(trips: DataFrame) -> DataFrame:
    """One row per vehicle with every fact the trend rules read."""
    # stored once for all the passes below
    trips = tr.laid_out(tr.narrow(trips, *[c for c in trips.columns if c in _FACTS]))
    sensor = trips.filter(is_sensor())
    key = F.struct("start", "trip_id")
    known = lambda c: F.when(F.col(c).isNotNull(), key)
    latest = sensor.groupBy("vehicle_id").agg(
        F.max_by("dpf_since_regen_km", known("dpf_since_regen_km")).alias("since"),
        F.max_by("dpf_avg_regen_km", F.when(F.col("dpf_avg_regen_km") != 0, key)).alias("avg_regen"),
        F.max_by("dpf_closed_soot", known("dpf_closed_soot")).alias("soot"),
        F.max_by("adblue_range_km", known("adblue_range_km")).alias("adblue"),
        F.max_by("oil_dilution_pct", known("oil_dilution_pct")).alias("oil_last"),
        F.min_by("oil_dilution_pct", known("oil_dilution_pct")).alias("oil_first"),
        F.count("oil_dilution_pct").alias("oil_n"))
    service = trips.groupBy("vehicle_id").agg(
        F.max_by("km_to_service", known("km_to_service")).alias("km_service"),
        F.max_by("days_to_service", known("days_to_service")).alias("days_service"))

    def prefixed(df, p):
        return df.select("vehicle_id", *[stable(c, t).alias(f"{p}_{c}") for c, t in df.dtypes
                                         if c != "vehicle_id"])

    out = service.join(latest, "vehicle_id", "left")
    for df, p in ((tr.economy_stats(trips), "eco"), (tr.cost_stats(trips), "cost"),
                  (tr.battery_stats(trips), "bat")):
        out = out.join(prefixed(df, p), "vehicle_id", "left")
    return out


def x_next_regen() -> Column:
    since, avg = F.col("since"), F.col("avg_regen")
    pct, left = since / avg * 100.0, avg - since
    level = F.when(pct < 90, F.lit("info")).otherwise(F.lit("warning"))
    return (F.when(~F.coalesce(since.isNotNull() & (avg > 20), F.lit(False)), None)
            .when(left > 0, insight("dpf", level, message(V["next_regen"][0]),
                                    message(V["next_regen"][1], since, avg, pct, left)))
            .otherwise(insight("dpf", "warning", message(V["regen_overdue"][0]),
                               message(V["regen_overdue"][1], since, avg))))


def x_soot() -> Column:
    s = F.col("soot")
    title = message(V["soot"], s)
    return (F.when(s >= 7, insight("dpf", "warning", title, F.lit(V["soot_high"])))
            .when(s < 7, insight("dpf", "info", title, F.lit(V["soot_normal"]))))


def x_economy() -> Column:
    recent, older = F.col("eco_recent"), F.col("eco_older")
    worse = F.coalesce(recent < older * 0.9, F.lit(False))
    better = F.coalesce(recent > older * 1.08, F.lit(False))
    base = message(V["economy"][1], F.col("eco_median"), F.col("eco_n"), F.col("eco_best"),
                   F.col("eco_best_date"))
    more = (F.when(worse, message(V["economy_worse"], recent, (older - recent) / older * 100.0, older))
            .when(better, message(V["economy_better"], recent)).otherwise(F.lit("")))
    level = F.when(worse, F.lit("warning")).otherwise(F.lit("info"))
    return F.when(F.col("eco_n").isNotNull(), insight("fuel", level, message(V["economy"][0]),
                                                      F.concat(base, more)))


def x_cost() -> Column:
    body = message(V["cost"][1], F.col("cost_cost_per_100km"), F.col("cost_total_cost"), F.col("cost_n"))
    more = F.when(F.col("cost_recent_n") > 0,
                  message(V["cost_recent"], F.col("cost_recent_cost"), F.col("cost_recent_n"))
                  ).otherwise(F.lit(""))
    return F.when(F.col("cost_n").isNotNull(), insight("fuel", "info", message(V["cost"][0]),
                                                       F.concat(body, more)))


def x_battery() -> Column:
    last, med, n = F.col("bat_last"), F.col("bat_median"), F.col("bat_n")
    bad = (F.col("bat_recent") < F.col("bat_older") - 0.25) | (med < 9.3)
    return (F.when(n.isNull(), None)
            .when(bad, insight("battery", "warning", message(V["battery_bad"][0], last),
                               message(V["battery_bad"][1], med)))
            .otherwise(insight("battery", "info", message(V["battery_ok"][0], last),
                               message(V["battery_ok"][1], med, n))))


def x_oil() -> Column:
    last = F.col("oil_last")
    bad = (last > 5) | ((F.col("oil_n") >= 3) & (last > F.col("oil_first") + 1.0))
    title = message(V["oil"], last)
    return (F.when(last.isNull(), None)
            .when(bad, insight("engine", "warning", title, F.lit(V["oil_bad"])))
            .otherwise(insight("engine", "info", title, F.lit(V["oil_ok"]))))


def x_adblue() -> Column:
    a = F.col("adblue")
    title = message(V["adblue"], a)
    level = F.when(a < 500, F.lit("critical")).otherwise(F.lit("warning"))
    return (F.when(a < 1500, insight("adblue", level, title, F.lit(V["adblue_low"])))
            .when(a >= 1500, insight("adblue", "info", title, F.lit(V["adblue_ok"]))))


def x_service() -> Column:
    km, days = F.col("km_service"), F.col("days_service")
    said = F.coalesce(days != 0, F.lit(False))
    due = (km < 1500) | F.coalesce(days < 30, F.lit(False))
    over = (km <= 0) | (F.coalesce(nonzero(days), F.lit(99)) <= 0)
    level = F.when(over, F.lit("critical")).otherwise(F.lit("warning"))
    d1 = F.when(said, message(V["service_due_days"], days)).otherwise(F.lit(""))
    d2 = F.when(said, message(V["service_ok_days"], days)).otherwise(F.lit(""))
    return (F.when(km.isNull(), None)
            .when(due, insight("service", level, message(V["service_due"][0]),
                               message(V["service_due"][1], km, d1)))
            .otherwise(insight("service", "info", message(V["service_ok"][0]),
                               message(V["service_ok"][1], km, d2))))


VEHICLE_RULES = [x_next_regen, x_soot, x_economy, x_cost, x_battery, x_oil, x_adblue, x_service]


def cross_trip_insights(trips: DataFrame, rules=tuple(VEHICLE_RULES)) -> DataFrame:
    """Trend insights, one row each: (vehicle_id, ord, category, level, title, body)."""
    facts = vehicle_facts(trips)
    rows = facts.select("vehicle_id", F.array_compact(F.array(*[r() for r in rules])).alias("insights"))
    return explode_insights(rows, "vehicle_id")


# -- threshold variants --------------------------------------------------------

VARIANTS = [
    # rule id, column, comparison, limit, level (first match of a rule wins)
    ("soot_pct", "dpf_soot_pct", ">=", 90.0, "critical"),
    ("soot_pct", "dpf_soot_pct", ">=", 70.0, "warning"),
    ("egt_spike", "exhaust_after_cat_c", ">", 700.0, "warning"),
    ("oil_dilution", "oil_dilution_pct", ">", 3.0, "critical"),
    ("oil_dilution", "oil_dilution_pct", ">", 1.5, "warning"),
    ("stop_start", "ss_state", "=", 9.0, "warning"),
    ("oil_change", "km_to_oil_change", "<", 2000.0, "warning"),
    ("coolant_cold", "coolant_first_c", "<", 40.0, "info"),
]


def threshold_insights(trips: DataFrame, variants=VARIANTS) -> DataFrame:
    """Rule variants that are one comparison each: (trip_id, rule_id, level, value)."""
    hits = []
    for rule in dict.fromkeys(v[0] for v in variants):
        level, value = None, None
        for _, c, op, limit, lvl in (v for v in variants if v[0] == rule):
            if c not in trips.columns:
                continue
            cond = F.expr(f"`{c}` {op} {limit}")
            level = F.when(cond, F.lit(lvl)) if level is None else level.when(cond, F.lit(lvl))
            value = F.col(c).cast("double")
        if level is not None:
            hits.append(F.when(level.isNotNull(), F.struct(
                F.lit(rule).alias("rule_id"), level.alias("level"), value.alias("value"))))
    rows = trips.select("trip_id", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return rows.select("trip_id", "h.*")


def regen_capability_drop(trips: DataFrame, share: float = 0.5) -> DataFrame:
    """Short-term capability below a share of the long-term one."""
    st, lt = F.col("dpf_regen_capability_st"), F.col("dpf_regen_capability")
    return trips.filter(st < lt * share).select("trip_id", st.alias("short_term"), lt.alias("long_term"))


def consumption_context(trips: DataFrame, short_km: float = 5.0, short_l100: float = 15.0,
                        good: float = 4.5, high: float = 8.0) -> DataFrame:
    """Class of a trip's consumption: short, excellent, high."""
    c = (F.when((F.col("distance_km") < short_km) & (F.col("l100km") > short_l100), "short")
         .when(F.col("l100km") < good, "excellent").when(F.col("l100km") > high, "high"))
    return trips.withColumn("context", c).filter(F.col("context").isNotNull()).select(
        "trip_id", "context", "l100km")


def dpf_alert_enrich(trips: DataFrame, code: int = fv.DPF_ALERT_CODE) -> DataFrame:
    """Text for trips whose cloud alerts name the filter, confirmed by soot if known."""
    soot = nonzero("dpf_soot_pct")
    text = F.when(soot.isNotNull(), message(fv.DPF_ALERT_CONFIRMED, soot)).otherwise(
        F.lit(fv.DPF_ALERT_UNCONFIRMED))
    return trips.filter(F.array_contains("alerts", code)).select("trip_id", text.alias("text"))
