"""Per-sensor statistics, catalog and downsampled series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tripweave import fixed_values as fv
from tripweave.functions import noise, py_round, sensor_group, short_name, slugify
from tripweave.operators import ordered as o

SERIES_POINTS = 60
STALE_AFTER_S = 60
MAX_DISCRETE = 32


def slug_table(spark) -> DataFrame:
    """Sensor name to slug, a fixed dimension of 81 rows."""
    return spark.createDataFrame(list(fv.SLUGS.items()), "pid string, curated_slug string")


def with_slug(sensors: DataFrame, slugs: DataFrame) -> DataFrame:
    """Curated slug where the dimension has one, else the slugified name."""
    return (sensors.join(slugs, "pid", "left")
            .withColumn("slug", F.coalesce("curated_slug", slugify("pid"))))


def first_per_slug(sensors: DataFrame) -> DataFrame:
    """Of the sensors of a trip sharing a slug, keep the one that appeared first.

    Works on one row per (trip, sensor), so the window holds a handful of rows.
    """
    w = Window.partitionBy("trip_id", "slug").orderBy("first_seq")
    return (sensors.withColumn("_rank", F.row_number().over(w))
            .filter(F.col("_rank") == 1).drop("_rank"))


def value_groups(windowed: DataFrame) -> DataFrame:
    """First level: one row per (trip, sensor, value rounded to 0.1).

    Only primitive buffers, so both the partial and the final step are hash
    aggregates; the partial step shrinks the rows before the exchange.
    """
    return (windowed.withColumn("rounded", py_round("value", 1, inline=True))
            .groupBy("trip_id", "pid", "rounded")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
                 F.min("value").alias("lo"), F.max("value").alias("hi"),
                 F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
                 F.min_by("value", "seq").alias("first_value"),
                 F.max_by("value", "seq").alias("last_value"),
                 F.min_by("sec", "seq").alias("first_sec"),
                 F.max_by("sec", "seq").alias("last_sec"),
                 F.bool_and(F.rint("value") == F.col("value")).alias("whole"),
                 F.min(F.rint("value")).alias("int_lo"), F.max(F.rint("value")).alias("int_hi"),
                 F.max("t_start").alias("t_start"), F.max("t_end").alias("t_end")))


def mode_of_groups(groups: DataFrame) -> DataFrame:
    """Most frequent 0.1-rounded value, ties to the one seen first."""
    return groups.groupBy("trip_id", "pid").agg(
        F.min_by("rounded", F.struct(-F.col("n"), F.col("first_seq"))).alias("mode"))


def group_stats(groups: DataFrame) -> DataFrame:
    """Second level: one row per (trip, sensor)."""
    return groups.groupBy("trip_id", "pid").agg(
        F.max_by("last_value", "last_seq").alias("last"),
        F.min_by("first_value", "first_seq").alias("first"),
        F.min("lo").alias("min"), F.max("hi").alias("max"),
        (F.sum("total") / F.sum("n")).alias("mean"),
        F.min_by("rounded", F.struct(-F.col("n"), F.col("first_seq"))).alias("mode"),
        F.sum("n").alias("samples"),
        F.count(F.lit(1)).alias("distinct_rounded"),
        F.bool_and("whole").alias("whole"),
        F.min("int_lo").alias("int_lo"), F.max("int_hi").alias("int_hi"),
        F.min_by("first_sec", "first_seq").alias("first_sec"),
        F.max_by("last_sec", "last_seq").alias("last_sec"),
        F.max("t_start").alias("t_start"), F.max("t_end").alias("t_end"))


def kind_of(unit="unit"):
    """number / bool / discrete.

    When every value is whole, distinct rounded values are the distinct integers.
    """
    flag = (F.col("int_lo") >= 0) & (F.col("int_hi") <= 1)
    few = F.col("whole") & (F.col("distinct_rounded") <= MAX_DISCRETE)
    return (F.when(F.col(unit) != "", F.lit("number")).when(flag, F.lit("bool"))
            .when(few, F.lit("discrete")).otherwise(F.lit("number")))


def useful_of():
    return (F.when(noise("pid"), F.lit(False))
            .when(F.col("curated_slug").isNotNull(), F.lit(True))
            .when(F.col("unit") == "", F.lit(False))
            .otherwise(F.col("min") != F.col("max")))


def pid_stats(windowed: DataFrame, facts: DataFrame, slugs: DataFrame,
              rounded: bool = True) -> DataFrame:
    """Fourteen statistics per (trip, slug) plus the catalog columns.

    ``facts`` is (trip_id, pid, first_seq, unit) over the whole file.
    """
    return stats_of_groups(value_groups(windowed), facts, slugs, rounded)


def stats_of_groups(groups: DataFrame, facts: DataFrame, slugs: DataFrame, rounded: bool = True) -> DataFrame:
    """``pid_stats`` from first-level groups; first_seq and last_seq may be of any ordered type."""
    stats = group_stats(groups).join(facts, ["trip_id", "pid"])
    stats = first_per_slug(with_slug(stats, slugs))
    span = F.when(F.col("samples") > 1, F.col("last_sec") - F.col("first_sec")).otherwise(1.0)
    length = F.greatest(F.col("t_end") - F.col("t_start"), F.lit(1.0))

    def r(c, digits):
        return py_round(c, digits) if rounded else c

    return stats.select(
        "trip_id", "slug", "pid",
        r(F.col("last"), 3).alias("last"), r(F.col("first"), 3).alias("first"),
        r(F.col("min"), 3).alias("min"), r(F.col("max"), 3).alias("max"),
        r(F.col("mean"), 3).alias("mean"), "mode", "samples", kind_of().alias("kind"),
        r(F.col("first_sec") - F.col("t_start"), 1).alias("first_seen_s"),
        r(F.col("last_sec") - F.col("t_start"), 1).alias("last_seen_s"),
        r(F.col("t_end") - F.col("last_sec"), 1).alias("age_from_trip_end_s"),
        r(span / length * 100, 1).alias("coverage_pct"),
        r(F.col("samples") / F.greatest(span, F.lit(1.0)), 3).alias("sample_rate_hz"),
        ((F.col("t_end") - F.col("last_sec")) > STALE_AFTER_S).alias("is_stale"),
        "unit", short_name("pid").alias("short"), sensor_group("pid").alias("group"),
        useful_of().alias("useful"), "first_seq")


def downsample(series: DataFrame, points: int = SERIES_POINTS,
               chunk_rows: int = o.CHUNK_ROWS) -> DataFrame:
    """Evenly spaced points per (trip, sensor) by index, both ends kept.

    Index ``round(i * (len - 1) / (points - 1))``, half to even; a series of at
    most ``points`` rows is returned unchanged.
    """
    scanned = o.ordered_scan(series, ["trip_id", "pid"], ["seq"],
                             o.chunk_by_sequence("seq", chunk_rows),
                             _pos=o.position(), _len=o.group_size())
    pos = (F.col("_pos") - 1).cast("double")
    step = (F.col("_len") - 1).cast("double") / float(points - 1)
    near = F.rint(pos / F.greatest(step, F.lit(1e-9)))
    i = F.coalesce(*[F.when((near + d).between(0, points - 1) & (F.rint((near + d) * step) == pos),
                            near + d) for d in (0.0, -1.0, 1.0)])
    idx = F.when(F.col("_len") <= points, pos).otherwise(i)
    return (scanned.withColumn("point", idx.cast("int")).filter(F.col("point").isNotNull())
            .drop("_pos", "_len"))


def series_map(points: DataFrame) -> DataFrame:
    """Nested form: one map slug -> list of at most 60 values per trip."""
    lists = points.groupBy("trip_id", "slug").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("point", "value"))),
                    lambda p: p["value"]).alias("values"))
    return lists.groupBy("trip_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("slug", "values")))).alias("series"))


def catalog_merge(catalog: DataFrame, trips: DataFrame) -> DataFrame:
    """One entry per slug over all trips, newest trip first; the newest entry
    flagged useful replaces a non-useful one.

    Aggregated with max_by, so no slug's entries are gathered in one task.
    """
    dated = catalog.join(trips.select("trip_id", "start"), "trip_id")
    entry = F.struct("pid", "short", "unit", "kind", "group", "useful", "trip_id")
    rank = F.struct(F.col("useful").cast("int"), F.col("start"), F.col("trip_id"))
    return dated.groupBy("slug").agg(F.max_by(entry, rank).alias("e")).select("slug", "e.*")


def pid_groups(catalog: DataFrame) -> DataFrame:
    """Group -> its slugs (the merged catalog has one row per slug)."""
    return catalog.groupBy("group").agg(
        F.array_sort(F.collect_list("slug")).alias("slugs"))


def catalog_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("trip_id").agg(
        F.count_if("useful").alias("useful"), F.count(F.lit(1)).alias("total"))


def pid_filter(catalog: DataFrame, show_all: bool = False, group: str | None = None,
               kind: str | None = None, text: str | None = None) -> DataFrame:
    out = catalog
    if not show_all:
        out = out.filter("useful")
    if group is not None:
        out = out.filter(F.col("group") == group)
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    q = (text or "").strip().lower()
    if q:
        out = out.filter(F.lower("pid").contains(q) | F.lower("short").contains(q)
                         | F.lower("slug").contains(q))
    return out


def with_data(catalog: DataFrame, stats: DataFrame) -> DataFrame:
    """Catalog entries that have data (semi join on trip and slug)."""
    return catalog.join(stats, ["trip_id", "slug"], "left_semi")


def pid_sort(catalog: DataFrame, by: str = "name") -> DataFrame:
    orders = {
        "name": [F.asc("pid")],
        "group": [F.asc("group"), F.asc("pid")],
        "samples": [F.desc("samples"), F.asc("pid")],
        "rate": [F.desc("sample_rate_hz"), F.asc("pid")],
    }
    return catalog.orderBy(*orders[by], "trip_id")
