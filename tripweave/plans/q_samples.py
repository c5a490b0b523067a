"""Registered queries over sensor samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.functions import color_ramp, sensor_group, short_name, slugify
from tripweave.operators import dpf, geo, pid_stats as ps, samples as sm, trends as tr
from tripweave.operators import trip_fields as tf
from tripweave.plans import views as v
from tripweave.plans.registry import query, r6, s6
from tripweave.plans.views import add_view, dec

FIELDS = [
    ("avg_speed_kmh", "mean", ["click"]), ("max_speed_kmh", "max", ["click"]),
    ("avg_rpm", "mean", ["purchase", "signup"]), ("air_temp_c", "first", ["error", "signup", "view"]),
    ("odometer_km", "last", ["signup", "purchase"]), ("coolant_max_c", "max", ["purchase", "click"]),
    ("low_v", "min", ["view", "click"]), ("distance_km_raw", "last", ["error"]),
]
CORRECTIONS = [("purchase", 16.0, 1.0, 0.0), ("click", 10.24, 1.0, 0.0), ("view", 1.0, 0.1, 0.0),
               ("signup", 1.0, 16.0, 5.0)]
SLUGS = [("view", "page"), ("click", "page"), ("purchase", "buy")]
RULES = dpf.DpfRules(
    sensors={"status": "view", "enable": "signup", "egt_after": "click", "nox_cat": "purchase",
             "inlet": "error", "outlet": "error", "soot": "signup", "distance": "purchase"},
    level=20.0, min_requests=2, reset_run=2, after_limit=120.0, filter_limit=150.0, reset_from=20.0,
    reset_share=0.5, soot_empty=15.0, cooldown_below=10.0, post_below=25.0)
DESIGN = dpf.DpfRules(**{**RULES.__dict__, "min_requests": 1, "reset_run": 1,
                         "use_filter_temps": False})

# -- window and GPS --------------------------------------------------------------


@query("engine_window", """
SELECT trip_id, t_start, t_end,
       CASE WHEN bool_or(pid = 'view') THEN 'view' WHEN bool_or(pid = 'click') THEN 'click' ELSE '' END AS anchor
FROM samples_v JOIN win_v USING (trip_id) GROUP BY ALL""", ("win_v",))
def engine_window(spark, d):
    return sm.engine_window(sm.anchor_bounds(v.samples(spark, d), v.ANCHORS), v.ANCHORS)


@query("window_clip", "SELECT trip_id, seq, pid, sec - t_start AS rel FROM clip_v", ("clip_v",))
def window_clip(spark, d):
    return v.windowed(spark, d)[1].select("trip_id", "seq", "pid",
                                          (F.col("sec") - F.col("t_start")).alias("rel"))


@query("gps_fix_filter", "SELECT trip_id, seq, lat, lon FROM clip_v WHERE lat <> 0 OR lon <> 0", ("clip_v",))
def gps_fix_filter(spark, d):
    return sm.gps_fixes(v.windowed(spark, d)[1]).select("trip_id", "seq", "lat", "lon")


add_view("fix_v", ["clip_v"], "SELECT * FROM clip_v WHERE lat <> 0 OR lon <> 0")
add_view("track_v", ["fix_v"], """
SELECT trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY seq) - 1 AS idx, seq, sec, lat, lon
FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fix_v
      WINDOW w AS (PARTITION BY trip_id ORDER BY seq))
WHERE plat IS NULL OR plat <> lat OR plon <> lon""")


def _fixes(spark, d):
    return sm.gps_fixes(v.windowed(spark, d)[1])


@query("gps_dedup", "SELECT trip_id, seq, lat, lon FROM track_v", ("track_v",))
def gps_dedup(spark, d):
    return sm.gps_dedup(_fixes(spark, d)).select("trip_id", "seq", "lat", "lon")


@query("gps_bbox", """
SELECT trip_id, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max,
       count(*) AS points FROM fix_v GROUP BY trip_id""", ("fix_v",))
def gps_bbox(spark, d):
    return sm.gps_bbox(_fixes(spark, d))


@query("sink_tracks", "SELECT trip_id, idx, lat, lon FROM track_v", ("track_v",))
def sink_tracks(spark, d):
    return sm.tracks(_fixes(spark, d)).select("trip_id", "idx", "lat", "lon")


# -- trip fields -----------------------------------------------------------------

def _agg(field, how, pids):
    sql = {"mean": "avg(value)", "max": "max(value)", "min": "min(value)",
           "first": "arg_min(value, seq)", "last": "arg_max(value, seq)"}[how]
    return "coalesce(" + ", ".join(f"{sql} FILTER (pid = '{p}')" for p in pids) + ")"


add_view("fields_v", ["clip_v"], "SELECT trip_id, " + ", ".join(
    f"{_agg(*f)} AS {f[0]}" for f in FIELDS) + " FROM clip_v GROUP BY trip_id")


@query("trip_curated_aggs", "SELECT trip_id, " + ", ".join(s6(f[0]) for f in FIELDS) + " FROM fields_v",
       ("fields_v",))
def trip_curated_aggs(spark, d):
    out = tf.curated_fields(v.windowed(spark, d)[1], FIELDS)
    return out.select("trip_id", *[r6(f[0]) for f in FIELDS])


add_view("area_v", ["clip_v"], """
SELECT trip_id, pid, count(*) AS samples, CASE WHEN count(*) >= 2 THEN greatest(sum(a), 0) END AS integral
FROM (SELECT trip_id, pid, (sec - lag(sec) OVER w) / 3600e0 * (value + lag(value) OVER w) / 2e0 AS a
      FROM clip_v WHERE pid IN ('purchase', 'click')
      WINDOW w AS (PARTITION BY trip_id, pid ORDER BY seq)) GROUP BY trip_id, pid""")


@query("integrate_trapezoid", f"SELECT trip_id, pid, samples, {s6('integral')} FROM area_v", ("area_v",))
def integrate_trapezoid(spark, d):
    out = tf.integrate(v.windowed(spark, d)[1], ["purchase", "click"])
    return out.select("trip_id", "pid", "samples", r6("integral"))


add_view("odo_v", ["clip_v"], """
SELECT trip_id, CASE WHEN n >= 2 AND b - a > 0 AND b - a < 2000 THEN b - a END AS odo_delta_km
FROM (SELECT trip_id, arg_min(value, seq) AS a, arg_max(value, seq) AS b, count(*) AS n
      FROM clip_v WHERE pid = 'signup' GROUP BY trip_id)""")


@query("odometer_delta", f"SELECT trip_id, {s6('odo_delta_km')} FROM odo_v", ("odo_v",))
def odometer_delta(spark, d):
    return tf.odometer_delta(v.windowed(spark, d)[1], "signup").select("trip_id", r6("odo_delta_km"))


add_view("dist_v", ["win_v", "fields_v", "area_v", "odo_v"], """
SELECT w.trip_id, t_start, t_end, f.* EXCLUDE (trip_id), fuel_l, gps_km, odo_delta_km,
       CASE WHEN distance_km_raw > 0 THEN distance_km_raw WHEN odo_delta_km >= 2 THEN odo_delta_km
            ELSE gps_km END AS distance_km,
       CASE WHEN distance_km_raw > 0 THEN 'trip_counter' WHEN odo_delta_km >= 2 THEN 'odometer'
            ELSE 'gps' END AS distance_source
FROM win_v w LEFT JOIN fields_v f USING (trip_id)
LEFT JOIN (SELECT trip_id, max(integral) FILTER (pid = 'purchase') AS fuel_l,
                  max(integral) FILTER (pid = 'click') AS gps_km FROM area_v GROUP BY trip_id) USING (trip_id)
LEFT JOIN odo_v USING (trip_id)""")


def _totals(spark, d):
    windows, clipped = v.windowed(spark, d)
    odo = tf.odometer_delta(clipped, "signup")
    areas = tf.integrate(clipped, ["purchase", "click"]).groupBy("trip_id").agg(
        F.max(F.when(F.col("pid") == "purchase", F.col("integral"))).alias("fuel_l"),
        F.max(F.when(F.col("pid") == "click", F.col("integral"))).alias("gps_km"))
    rows = (windows.join(tf.curated_fields(clipped, FIELDS), "trip_id", "left")
            .join(areas, "trip_id", "left").join(odo, "trip_id", "left"))
    return tf.resolve_distance(rows)


@query("resolve_distance", f"SELECT trip_id, {s6('distance_km')}, distance_source FROM dist_v", ("dist_v",))
def resolve_distance(spark, d):
    return _totals(spark, d).select("trip_id", r6("distance_km"), "distance_source")


@query("short_trip_filter", """
SELECT trip_id, distance_source FROM dist_v WHERE coalesce(distance_km, 0) >= 30""", ("dist_v",))
def short_trip_filter(spark, d):
    return tf.short_trip_filter(_totals(spark, d), minimum=30.0).select("trip_id", "distance_source")


@query("trip_summary", f"""
SELECT trip_id, {s6('(t_end - t_start) / 60e0', 'duration_min')}, {s6('distance_km')}, distance_source,
       {s6('fuel_l')}, {s6('avg_speed_kmh')}, {s6('max_speed_kmh')}, {s6('avg_rpm')}, {s6('air_temp_c')},
       {s6('odometer_km')}, {s6('coolant_max_c')}
FROM dist_v WHERE coalesce(distance_km, 0) >= 1""", ("dist_v",))
def trip_summary(spark, d):
    windows, clipped = v.windowed(spark, d)
    out = tf.trip_totals(clipped, windows, FIELDS, "purchase", "click", "signup", rounded=False)
    return out.select("trip_id", r6("duration_min"), r6("distance_km"), "distance_source", r6("fuel_l"),
                      r6("avg_speed_kmh"), r6("max_speed_kmh"), r6("avg_rpm"), r6("air_temp_c"),
                      r6("odometer_km"), r6("coolant_max_c"))


# -- sensor statistics -----------------------------------------------------------

def _slugs(spark):
    return spark.createDataFrame(SLUGS, "pid string, curated_slug string")


def _stats(spark, d, rounded=False):
    clipped = v.windowed(spark, d)[1]
    return ps.pid_stats(clipped, sm.sensor_facts(v.samples(spark, d)), _slugs(spark), rounded)


add_view("slug_v", ["samples_v", "clip_v"], """
SELECT * FROM (
  SELECT trip_id, pid, first_seq, unit, coalesce(curated, pid) AS slug, curated,
         row_number() OVER (PARTITION BY trip_id, coalesce(curated, pid) ORDER BY first_seq) AS rank
  FROM (SELECT trip_id, pid, min(seq) AS first_seq, arg_max(unit, seq) AS unit,
               CASE pid WHEN 'view' THEN 'page' WHEN 'click' THEN 'page' WHEN 'purchase' THEN 'buy' END AS curated
        FROM samples_v WHERE (trip_id, pid) IN (SELECT (trip_id, pid) FROM clip_v)
        GROUP BY trip_id, pid))
WHERE rank = 1""")
add_view("mode_v", ["clip_v"], f"""
SELECT trip_id, pid, arg_max(r, (n, -f)) AS mode FROM (
  SELECT trip_id, pid, {dec('value', 1)} AS r, count(*) AS n, min(seq) AS f FROM clip_v GROUP BY 1, 2, 3)
GROUP BY trip_id, pid""")
add_view("stats_v", ["slug_v", "mode_v"], """
SELECT trip_id, slug, pid, unit, last, first, lo, hi, mean, mode, samples,
       CASE WHEN unit <> '' THEN 'number' WHEN ilo >= 0 AND ihi <= 1 THEN 'bool'
            WHEN whole AND ints <= 32 THEN 'discrete' ELSE 'number' END AS kind,
       first_sec - t_start AS first_seen_s, last_sec - t_start AS last_seen_s,
       t_end - last_sec AS age_from_trip_end_s,
       CASE WHEN samples > 1 THEN last_sec - first_sec ELSE 1 END / greatest(t_end - t_start, 1) * 100 AS coverage_pct,
       samples / greatest(CASE WHEN samples > 1 THEN last_sec - first_sec ELSE 1 END, 1) AS sample_rate_hz,
       t_end - last_sec > 60 AS is_stale,
       CASE WHEN curated IS NOT NULL THEN true WHEN unit = '' THEN false ELSE lo <> hi END AS useful
FROM slug_v JOIN mode_v USING (trip_id, pid) JOIN (
  SELECT trip_id, pid, arg_max(value, seq) AS last, arg_min(value, seq) AS first, min(value) AS lo,
         max(value) AS hi, avg(value) AS mean, count(*) AS samples, min(round_even(value, 0)) AS ilo,
         max(round_even(value, 0)) AS ihi, bool_and(value = floor(value)) AS whole,
         count(DISTINCT round_even(value, 0)) AS ints, arg_min(sec, seq) AS first_sec,
         arg_max(sec, seq) AS last_sec, min(t_start) AS t_start, min(t_end) AS t_end
  FROM clip_v GROUP BY trip_id, pid) USING (trip_id, pid)""")
_STATS = ["last", "first", "mean", "mode", "first_seen_s", "last_seen_s", "age_from_trip_end_s",
          "coverage_pct", "sample_rate_hz"]


@query("pid_stats", f"""
SELECT trip_id, slug, pid, unit, {', '.join(s6(c) for c in _STATS)}, {s6('lo', 'min')}, {s6('hi', 'max')},
       samples, kind, is_stale FROM stats_v""", ("stats_v",))
def pid_stats(spark, d):
    return _stats(spark, d).select("trip_id", "slug", "pid", "unit", *[r6(c) for c in _STATS], r6("min"),
                                   r6("max"), "samples", "kind", "is_stale")


@query("pid_stats_rounded", f"""
SELECT trip_id, slug, {dec('last', 3)} AS last, {dec('lo', 3)} AS min, {dec('hi', 3)} AS max,
       {dec('first_seen_s', 1)} AS first_seen_s FROM stats_v""", ("stats_v",))
def pid_stats_rounded(spark, d):
    return _stats(spark, d, True).select("trip_id", "slug", "last", "min", "max", "first_seen_s")


@query("pid_mode", "SELECT trip_id, pid, mode FROM mode_v", ("mode_v",))
def pid_mode(spark, d):
    return ps.mode_of_groups(ps.value_groups(v.windowed(spark, d)[1]))


@query("pid_kind", "SELECT trip_id, slug, kind FROM stats_v", ("stats_v",))
def pid_kind(spark, d):
    return _stats(spark, d).select("trip_id", "slug", "kind")


@query("pid_useful", "SELECT trip_id, slug, useful FROM stats_v", ("stats_v",))
def pid_useful(spark, d):
    return _stats(spark, d).select("trip_id", "slug", "useful")


@query("slug_lookup", "SELECT DISTINCT trip_id, pid, coalesce(CASE pid WHEN 'view' THEN 'page' "
       "WHEN 'click' THEN 'page' WHEN 'purchase' THEN 'buy' END, pid) AS slug FROM samples_v", ("samples_v",))
def slug_lookup(spark, d):
    facts = sm.sensor_facts(v.samples(spark, d))
    return ps.with_slug(facts, _slugs(spark)).select("trip_id", "pid", "slug")


@query("slug_first_wins", "SELECT trip_id, slug, pid FROM slug_v", ("slug_v",))
def slug_first_wins(spark, d):
    clipped = v.windowed(spark, d)[1]
    present = sm.sensor_facts(v.samples(spark, d)).join(clipped.select("trip_id", "pid").distinct(), ["trip_id", "pid"],
                                          "left_semi")
    return ps.first_per_slug(ps.with_slug(present, _slugs(spark))).select("trip_id", "slug", "pid")


@query("downsample_n", """
SELECT trip_id, pid, CAST(CASE WHEN len <= 5 THEN pos ELSE i END AS INT) AS point, value FROM (
  SELECT user_id AS trip_id, event_type AS pid, value,
         row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id, event_type) AS len
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
LEFT JOIN range(0, 5) r(i) ON len > 5 AND round_even(i * ((len - 1) / 4e0), 0) = pos
WHERE len <= 5 OR i IS NOT NULL""")
def downsample_n(spark, d):
    rows = v.samples(spark, d).withColumn("trip_id", F.col("vehicle_id"))
    return ps.downsample(rows, 5).select("trip_id", "pid", "point", "value")


@query("downsample_map", """
SELECT user_id AS trip_id, event_type AS slug, array_to_string(list(value ORDER BY event_id), ' ') AS values
FROM events GROUP BY ALL""")
def downsample_map(spark, d):
    rows = v.samples(spark, d).withColumn("trip_id", F.col("vehicle_id")).withColumn("slug", F.col("pid"))
    maps = ps.series_map(ps.downsample(rows, 200))
    return maps.select("trip_id", F.explode("series").alias("slug", "values")).select(
        "trip_id", "slug", F.array_join(F.col("values").cast("array<string>"), " ").alias("values"))


def _catalog(spark, d):
    return _stats(spark, d).select("trip_id", "slug", "pid", "short", "unit", "kind", "group", "useful",
                                   "samples", "sample_rate_hz")


def _trip_starts(spark, d):
    return v.samples(spark, d).groupBy("trip_id").agg(F.min("sec").alias("start"))


add_view("merged_v", ["stats_v", "samples_v"], """
SELECT slug, pid, unit, kind, useful, trip_id FROM (
  SELECT *, row_number() OVER (PARTITION BY slug ORDER BY useful DESC, start DESC, trip_id DESC) AS r
  FROM stats_v JOIN (SELECT trip_id, min(sec) AS start FROM samples_v GROUP BY 1) USING (trip_id))
WHERE r = 1""")


@query("catalog_merge", "SELECT * FROM merged_v", ("merged_v",))
def catalog_merge(spark, d):
    return ps.catalog_merge(_catalog(spark, d), _trip_starts(spark, d)).select(
        "slug", "pid", "unit", "kind", "useful", "trip_id")


@query("pid_groups", """
SELECT kind AS "group", array_to_string(list_sort(list(slug)), ',') AS slugs FROM merged_v GROUP BY 1""",
       ("merged_v",))
def pid_groups(spark, d):
    merged = ps.catalog_merge(_catalog(spark, d), _trip_starts(spark, d)).withColumn("group", F.col("kind"))
    return ps.pid_groups(merged).select("group", F.array_join("slugs", ",").alias("slugs"))


@query("catalog_counts", """
SELECT trip_id, count(*) FILTER (useful) AS useful, count(*) AS total FROM stats_v GROUP BY trip_id""",
       ("stats_v",))
def catalog_counts(spark, d):
    return ps.catalog_counts(_catalog(spark, d))


@query("pid_filter", """
SELECT trip_id, slug FROM stats_v WHERE useful AND kind = 'number' AND (contains(pid, 'u') OR contains(slug, 'u'))""",
       ("stats_v",))
def pid_filter(spark, d):
    return ps.pid_filter(_catalog(spark, d), kind="number", text=" U ").select("trip_id", "slug")


@query("pid_semi", """
SELECT m.slug, t.trip_id FROM merged_v m, (SELECT DISTINCT trip_id FROM samples_v) t
WHERE (t.trip_id, m.slug) IN (SELECT (trip_id, slug) FROM stats_v)""", ("merged_v",))
def pid_semi(spark, d):
    stats = _catalog(spark, d)
    merged = ps.catalog_merge(stats, _trip_starts(spark, d)).select("slug")
    # the merged catalog has one row per slug; entries with data in a trip are read off the statistics
    return stats.join(merged, "slug", "left_semi").select("slug", "trip_id")


@query("pid_sort", "SELECT trip_id, slug, samples FROM stats_v ORDER BY samples DESC, pid, trip_id", ("stats_v",))
def pid_sort(spark, d):
    return ps.pid_sort(_catalog(spark, d), "samples").select("trip_id", "slug", "samples")


# -- corrections -----------------------------------------------------------------

add_view("fix_dim_v", [], "SELECT * FROM (VALUES " + ", ".join(
    f"('{p}', {a}e0, {b}e0, {c}e0)" for p, a, b, c in CORRECTIONS) + ") t(pid, div, mul, ofs)")


@query("swap_correct", f"""
SELECT seq, pid, {s6('CASE WHEN div IS NULL OR raw NOT BETWEEN 0 AND 65535 THEN value ELSE '
                     '((CAST(raw AS INT) & 255) * 256 + CAST(raw AS INT) // 256) * mul / div + ofs END', 'value')}
FROM (SELECT *, CASE WHEN r < 0 THEN r + 65536 ELSE r END AS raw FROM (
  SELECT s.*, div, mul, ofs, round_even((value - ofs) * div / mul, 0) AS r
  FROM samples_v s LEFT JOIN fix_dim_v USING (pid)))""", ("samples_v", "fix_dim_v"))
def swap_correct(spark, d):
    dim = spark.createDataFrame(CORRECTIONS, "pid string, div double, mul double, ofs double")
    return sm.correct_values(v.samples(spark, d), dim).select("seq", "pid", r6("value", inline=True))


@query("correction_lookup", """
SELECT pid, coalesce(div, 1) AS div, coalesce(mul, 1) AS mul, coalesce(ofs, 0) AS ofs, count(*) AS samples
FROM samples_v LEFT JOIN fix_dim_v USING (pid) GROUP BY ALL""", ("samples_v", "fix_dim_v"))
def correction_lookup(spark, d):
    dim = spark.createDataFrame(CORRECTIONS, "pid string, div double, mul double, ofs double")
    counts = v.samples(spark, d).groupBy("pid").agg(F.count(F.lit(1)).alias("samples"))
    return counts.join(dim, "pid", "left").select(
        "pid", *[F.coalesce(c, F.lit(x)).alias(c) for c, x in (("div", 1.0), ("mul", 1.0), ("ofs", 0.0))],
        "samples")


# -- filter state ----------------------------------------------------------------

add_view("later_v", ["clip_v"], """
SELECT s.trip_id, s.seq, s.value, f.v0 FROM clip_v s JOIN (
  SELECT trip_id, min(seq) AS seq0, arg_min(value, seq) AS v0, count(*) AS n FROM clip_v
  WHERE pid = 'purchase' GROUP BY trip_id) f ON s.trip_id = f.trip_id AND s.pid = 'purchase' AND s.seq > f.seq0
  AND f.v0 > 20""")
add_view("runs_v", ["later_v"], """
SELECT trip_id, max(run) AS longest_run FROM (
  SELECT trip_id, CASE WHEN low THEN count(*) OVER (PARTITION BY trip_id, low, rn - rl ORDER BY seq) ELSE 0 END AS run
  FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY seq) AS rn,
               row_number() OVER (PARTITION BY trip_id, low ORDER BY seq) AS rl
        FROM (SELECT *, value < v0 * 0.5e0 AS low FROM later_v)))
GROUP BY trip_id""")


@query("run_length_below", """
SELECT trip_id, pid, max(CASE WHEN low THEN n ELSE 0 END) AS longest_run FROM (
  SELECT trip_id, pid, low, count(*) OVER (PARTITION BY trip_id, pid, low, rn - rl) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY trip_id, pid ORDER BY seq) AS rn,
           row_number() OVER (PARTITION BY trip_id, pid, low ORDER BY seq) AS rl
    FROM (SELECT user_id AS trip_id, event_type AS pid, event_id AS seq, value < 30 AS low FROM events)))
GROUP BY trip_id, pid""")
def run_length_below(spark, d):
    rows = v.samples(spark, d).select(F.col("vehicle_id").alias("trip_id"), "pid", "seq", "value")
    return dpf.run_length_below(rows, ["trip_id", "pid"], F.lit(30.0))


def _state_sql(r: dpf.DpfRules) -> str:
    temps = "OR coalesce(inlet > 150, false)" if r.use_filter_temps else ""
    return f"""
SELECT trip_id, CASE WHEN active AND (reset OR coalesce(soot_last <= 15, false)) THEN 'completed'
    WHEN active THEN 'active' WHEN requested AND NOT thermal THEN 'requested'
    WHEN (coalesce(dist_last < 25, false) AND NOT active)
      OR (coalesce(dist_first < 10, false) AND thermal AND NOT requested) THEN 'post_regen'
    ELSE 'idle' END AS dpf_state, CAST(active AS INT) AS dpf_regen_active
FROM (SELECT *, requested AND enabled AND thermal AS active FROM (
  SELECT f.*, requests >= {r.min_requests} AS requested, enable IS NULL OR enable >= 20 AS enabled,
         coalesce(egt > 120, false) OR coalesce(nox > 120, false) {temps} AS thermal,
         dist_n >= {r.reset_run + 1} AND coalesce(longest_run, 0) >= {r.reset_run} AS reset
  FROM (SELECT trip_id, count(*) FILTER (pid = 'view' AND value >= 20) AS requests,
               max(value) FILTER (pid = 'signup') AS enable, max(value) FILTER (pid = 'click') AS egt,
               max(value) FILTER (pid = 'purchase') AS nox, max(value) FILTER (pid = 'error') AS inlet,
               arg_max(value, seq) FILTER (pid = 'signup') AS soot_last,
               arg_min(value, seq) FILTER (pid = 'purchase') AS dist_first,
               arg_max(value, seq) FILTER (pid = 'purchase') AS dist_last,
               count(*) FILTER (pid = 'purchase') AS dist_n FROM clip_v GROUP BY trip_id) f
  LEFT JOIN runs_v USING (trip_id)))"""


@query("dpf_state", _state_sql(RULES), ("clip_v", "runs_v"))
def dpf_state(spark, d):
    return dpf.dpf_state(v.windowed(spark, d)[1], RULES).select("trip_id", "dpf_state", "dpf_regen_active")


@query("dpf_state_design", _state_sql(DESIGN), ("clip_v", "runs_v"))
def dpf_state_design(spark, d):
    return dpf.dpf_state(v.windowed(spark, d)[1], DESIGN).select("trip_id", "dpf_state", "dpf_regen_active")


# -- map -------------------------------------------------------------------------

@query("pid_series_get", "SELECT trip_id, seq, sec, value FROM samples_v WHERE pid = 'click'", ("samples_v",))
def pid_series_get(spark, d):
    return v.samples(spark, d).filter("pid = 'click'").select("trip_id", "seq", "sec", "value")


add_view("cursor_v", ["win_v"], "SELECT trip_id, t_start + (t_end - t_start) * 0.5e0 AS cursor_sec FROM win_v")


@query("values_at_time", """
SELECT trip_id, pid, arg_max(value, seq) AS value, arg_max(sec, seq) AS sec
FROM clip_v JOIN cursor_v USING (trip_id) WHERE sec <= cursor_sec GROUP BY trip_id, pid""",
       ("clip_v", "cursor_v"))
def values_at_time(spark, d):
    windows, clipped = v.windowed(spark, d)
    cursors = windows.select("trip_id", (F.col("t_start") + (F.col("t_end") - F.col("t_start")) * 0.5)
                             .alias("cursor_sec"))
    return sm.values_at_time(clipped, cursors)


add_view("valued_v", ["track_v", "clip_v"], """
SELECT trip_id, idx, sec, lat, lon, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t0 = sec THEN v0
       ELSE v0 + (v1 - v0) * (sec - t0) / (t1 - t0) END AS value
FROM (SELECT k.*, b.sec AS t0, b.value AS v0, a.sec AS t1, a.value AS v1 FROM track_v k
      ASOF LEFT JOIN (SELECT trip_id, sec, value FROM clip_v WHERE pid = 'click') b
        ON k.trip_id = b.trip_id AND k.sec >= b.sec
      ASOF LEFT JOIN (SELECT trip_id, sec, value FROM clip_v WHERE pid = 'click') a
        ON k.trip_id = a.trip_id AND k.sec < a.sec)""")


def _valued(spark, d):
    clipped = v.windowed(spark, d)[1]
    track = sm.tracks(sm.gps_fixes(clipped))
    series = clipped.filter("pid = 'click'").select("trip_id", "seq", "sec", "value")
    return geo.pid_at_gps(track, series, width=86_400.0)


@query("pid_at_gps", f"SELECT trip_id, idx, {s6('value')} FROM valued_v", ("valued_v",))
def pid_at_gps(spark, d):
    return _valued(spark, d).select("trip_id", "idx", r6("value"))


add_view("segments_v", ["valued_v"], """
SELECT trip_id, idx, value, lat, lon, lat2, lon2, (value - lo) / greatest(hi - lo, 1e-9) AS normalized
FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, min(value) OVER p AS lo, max(value) OVER p AS hi
      FROM valued_v WINDOW w AS (PARTITION BY trip_id ORDER BY idx), p AS (PARTITION BY trip_id))
WHERE lat2 IS NOT NULL""")


@query("pid_segments", f"SELECT trip_id, idx, lat, lon, lat2, lon2, {s6('normalized')} FROM segments_v",
       ("segments_v",))
def pid_segments(spark, d):
    return geo.pid_segments(_valued(spark, d)).select("trip_id", "idx", "lat", "lon", "lat2", "lon2",
                                                      r6("normalized"))


def _channel(a, b, c):
    n = "n"
    return (f"printf('%02x', CAST(floor(CASE WHEN {n} * 2 <= 1 THEN {a}e0 + ({n} * 2 - 0e0) * {b - a}e0 "
            f"ELSE {b}e0 + ({n} * 2 - 1e0) * {c - b}e0 END + 0.5e0) AS INT))")


@query("color_ramp", f"""
SELECT seq, '#' || {_channel(215, 255, 26)} || {_channel(25, 255, 150)} || {_channel(28, 191, 65)} AS color
FROM (SELECT event_id AS seq, least(greatest(value / 500e0, 0), 1) AS n FROM events)""")
def color_ramp_query(spark, d):
    return v.samples(spark, d).select("seq", color_ramp(F.col("value") / 500.0).alias("color"))


EVENTS = geo.EventRules(sensors={"regen": "view", "egt": "click", "speed": "purchase", "coolant": "error"},
                        regen_level=20.0, speed_limit=130.0, cold_below=40.0)
add_view("marks_v", ["clip_v"], """
SELECT trip_id, 'regen_start' AS category, min(seq) AS seq FROM clip_v WHERE pid = 'view' AND value >= 20 GROUP BY 1
UNION ALL SELECT trip_id, 'regen_end', max(seq) FROM clip_v WHERE pid = 'view' AND value >= 20 GROUP BY 1
UNION ALL SELECT trip_id, 'max_egt', arg_max(seq, (value, -seq)) FROM clip_v WHERE pid = 'click' GROUP BY 1
UNION ALL SELECT trip_id, 'speeding', seq FROM clip_v WHERE pid = 'purchase' AND value > 130
UNION ALL SELECT trip_id, 'cold_start', min(seq) FROM clip_v WHERE pid = 'error' AND value < 40 GROUP BY 1""")
add_view("trip_events_v", ["marks_v", "samples_v"], """
SELECT m.trip_id, category, m.seq, sec, value FROM marks_v m JOIN samples_v s USING (seq)""")


@query("trip_events", "SELECT * FROM trip_events_v", ("trip_events_v",))
def trip_events(spark, d):
    return geo.trip_events(v.windowed(spark, d)[1], EVENTS)


def _located(spark, d):
    clipped = v.windowed(spark, d)[1]
    marks = geo.trip_events(clipped, EVENTS).withColumn("n", F.concat("category", F.lit("/"), F.col("seq")))
    fixes = sm.gps_fixes(clipped).select("trip_id", F.col("seq").cast("string").alias("seq"), "sec", "lat", "lon")
    return geo.as_of_fix(marks, fixes, width=86_400.0)


add_view("located_v", ["trip_events_v", "fix_v"], """
SELECT e.*, coalesce(b.lat, a.lat) AS lat, coalesce(b.lon, a.lon) AS lon FROM trip_events_v e
ASOF LEFT JOIN fix_v b ON e.trip_id = b.trip_id AND e.sec >= b.sec
ASOF LEFT JOIN fix_v a ON e.trip_id = a.trip_id AND e.sec < a.sec""")


@query("gps_at_event", "SELECT trip_id, category, seq, lat, lon FROM located_v", ("located_v",))
def gps_at_event(spark, d):
    return _located(spark, d).select("trip_id", "category", "seq", "lat", "lon")


@query("geojson_points", """
SELECT trip_id, category || '/' || seq AS n, '{"type":"Feature","geometry":{"type":"Point","coordinates":['
   || lon || ',' || lat || ']},"properties":{"category":"' || category || '","value":' || value || '}}' AS feature
FROM located_v WHERE lat IS NOT NULL""", ("located_v",))
def geojson_points(spark, d):
    return geo.point_features(_located(spark, d).filter("lat is not null"))


@query("geojson_export", """
SELECT trip_id, part, len(pts) AS points, '{"type":"Feature","geometry":{"type":"LineString","coordinates":['
   || array_to_string(pts, ',') || ']},"properties":{"trip_id":' || trip_id || '}}' AS feature
FROM (SELECT trip_id, part, list('[' || lon || ',' || lat || ']' ORDER BY idx) AS pts FROM (
        SELECT *, idx // 10 AS part FROM track_v
        UNION ALL SELECT *, idx // 10 - 1 FROM track_v WHERE idx % 10 = 0 AND idx > 0) GROUP BY ALL)""",
       ("track_v",))
def geojson_export(spark, d):
    points = sm.tracks(_fixes(spark, d))
    return geo.line_features(points, points_per_line=10)


@query("min_max_scale", f"""
SELECT seq, {s6('(value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END', 'scaled')} FROM (
  SELECT *, min(value) OVER p AS lo, max(value) OVER p AS hi FROM samples_v
  WINDOW p AS (PARTITION BY trip_id, pid))""", ("samples_v",))
def min_max_scale(spark, d):
    return tr.min_max_scale(v.samples(spark, d), ["trip_id", "pid"], "value").select("seq", r6("scaled", inline=True))


# -- names -----------------------------------------------------------------------

_NAME = "concat('[ECM] ', p_name, ' ', p_type, ' (', p_brand, ')')"


@query("slugify", f"""
SELECT p_partkey, trim(regexp_replace(lower(trim({_NAME})), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""")
def slugify_query(spark, d):
    return v.table(spark, d, "part").select("p_partkey", slugify(F.expr(_NAME)).alias("slug"))


@query("pid_short", f"SELECT p_partkey, left(trim(replace({_NAME}, '[ECM] ', '')), 32) AS short FROM part")
def pid_short(spark, d):
    return v.table(spark, d, "part").select("p_partkey", short_name(F.expr(_NAME)).alias("short"))


_WORDS = ("CASE p_partkey % 12 WHEN 0 THEN 'DPF ' WHEN 1 THEN 'EGT ' WHEN 2 THEN 'Urea ' WHEN 3 THEN 'Oil ' "
          "WHEN 4 THEN 'Altitude ' WHEN 5 THEN 'Rail ' WHEN 6 THEN 'Boost ' WHEN 7 THEN 'Clutch ' "
          "WHEN 8 THEN 'GPS ' WHEN 9 THEN 'Mileage ' WHEN 10 THEN 'Speed ' ELSE 'Zz ' END")


def _group_sql():
    from tripweave import fixed_values as fv
    cases = " ".join(f"WHEN regexp_matches(n, '{'|'.join(w)}') THEN '{g}'" for g, w in fv.SENSOR_GROUPS)
    return f"CASE {cases} ELSE '{fv.OTHER_GROUP}' END"


@query("pid_group", f"""
SELECT p_partkey, {_group_sql()} AS "group" FROM (
  SELECT p_partkey, lower(concat({_WORDS}, p_name, ' ', p_type)) AS n FROM part)""")
def pid_group(spark, d):
    return v.table(spark, d, "part").select(
        "p_partkey", sensor_group(F.expr(f"concat({_WORDS}, p_name, ' ', p_type)")).alias("group"))
