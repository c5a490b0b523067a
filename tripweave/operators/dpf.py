"""Particulate-filter regeneration state of a trip."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tripweave import fixed_values as fv
from tripweave.operators import ordered as o, runs


@dataclass(frozen=True)
class DpfRules:
    """Sensors and thresholds of the classifier; variants are other parameters."""

    sensors: dict = field(default_factory=lambda: dict(fv.DPF_SENSORS))
    level: float = 1.0            # a status or enable reading from here on is "on"
    min_requests: int = 3         # samples that make a request
    reset_run: int = 3            # consecutive low readings that make a reset
    after_limit: float = 550.0    # exhaust after the pre-catalyst, NOx catalyst
    filter_limit: float = 500.0   # filter inlet and outlet
    use_filter_temps: bool = True
    reset_from: float = 20.0      # a reset needs a first reading above this
    reset_share: float = 0.1      # ... and later readings below this share of it
    soot_empty: float = 0.5
    cooldown_below: float = 1.0
    post_below: float = 20.0


DESIGN_VARIANT = DpfRules(min_requests=1, reset_run=1, use_filter_temps=False)


def run_length_below(series: DataFrame, keys: list[str], threshold: Column,
                     chunk_rows: int = runs.CHUNK_ROWS) -> DataFrame:
    """Longest run of consecutive values below a threshold, per group."""
    return runs.longest_run(series, keys, F.col("value") < threshold, chunk_rows=chunk_rows)


def dpf_chunks(windowed: DataFrame, rules: DpfRules, chunk_rows: int = o.CHUNK_ROWS) -> DataFrame:
    """One row per (trip, chunk) with everything the state needs: features and, in order, the distance readings.

    Rows clipped on (trip, chunk) are where they have to be already, so nothing is exchanged for it.
    """
    s = rules.sensors
    chunk = F.col("chunk") if "chunk" in windowed.columns else o.chunk_by_sequence("seq", chunk_rows)
    rows = windowed.filter(F.col("pid").isin(*sorted(set(s.values())))).withColumn("chunk", chunk)

    def only(role, c="value"):
        return F.when(F.col("pid") == s[role], F.col(c))

    readings = F.array_sort(F.collect_list(F.when(F.col("pid") == s["distance"], F.struct("seq", "value"))))
    return rows.groupBy("trip_id", "chunk").agg(
        F.count_if((F.col("pid") == s["status"]) & (F.col("value") >= rules.level)).alias("requests"),
        F.max(only("enable")).alias("enable_max"),
        F.max(only("egt_after")).alias("egt_max"), F.max(only("nox_cat")).alias("nox_max"),
        F.max(only("inlet")).alias("inlet_max"), F.max(only("outlet")).alias("outlet_max"),
        F.max_by(only("soot"), only("soot", "seq")).alias("soot_last"), F.max(only("soot", "seq")).alias("soot_at"),
        readings.alias("readings"))


def dpf_features(chunks: DataFrame) -> DataFrame:
    """One row per trip with everything the state needs except the reset run."""
    first, last = F.get("readings", F.lit(0)), F.try_element_at("readings", F.lit(-1))
    rows = chunks.select("*", first.alias("_first"), last.alias("_last"))
    return rows.groupBy("trip_id").agg(
        F.sum("requests").alias("requests"),
        *[F.max(c).alias(c) for c in ("enable_max", "egt_max", "nox_max", "inlet_max", "outlet_max")],
        F.max_by("soot_last", "soot_at").alias("soot_last"),
        F.min_by("_first.value", "_first.seq").alias("dist_first"),
        F.max_by("_last.value", "_last.seq").alias("dist_last"),
        F.min("_first.seq").alias("dist_first_at"),
        F.sum(F.size("readings")).alias("dist_n"))


def dpf_state(windowed: DataFrame, rules: DpfRules = DpfRules(),
              chunk_rows: int = o.CHUNK_ROWS) -> DataFrame:
    """State per trip: idle, requested, active, completed or post_regen."""
    chunks = dpf_chunks(windowed, rules, chunk_rows)
    pieces = chunks.where(F.size("readings") > 0).select(
        "trip_id", F.col("chunk").alias("order"), F.get("readings", F.lit(0))["seq"].alias("first_at"),
        F.transform("readings", lambda r: r["value"]).alias("readings"))
    return state_of(dpf_features(chunks), pieces, rules)


def reset_runs(features: DataFrame, pieces: DataFrame, rules: DpfRules) -> DataFrame:
    """Longest run of low distance readings behind a trip's first one, for trips that can show a reset.

    ``pieces`` is (trip_id, order, first_at, readings): the readings piece by piece.
    """
    candidates = features.filter((F.col("dist_n") >= rules.reset_run + 1)
                                 & (F.col("dist_first") > rules.reset_from)).select("trip_id", "dist_first", "dist_first_at")
    later = F.when(F.col("first_at") == F.col("dist_first_at"), F.slice("readings", 2, 1 << 30)).otherwise(F.col("readings"))
    threshold = F.col("dist_first") * F.lit(rules.reset_share)
    rows = pieces.join(candidates, "trip_id").select(
        "trip_id", "order", runs.run_piece(F.transform(later, lambda v: v < threshold)).alias("piece"))
    return runs.fold_by(rows, ["trip_id"], F.col("order")).select("trip_id", F.col("piece.best").alias("longest_run"))


def state_of(features: DataFrame, pieces: DataFrame, rules: DpfRules = DpfRules()) -> DataFrame:
    """The state from per-trip features and the pieces of the distance readings."""
    f = features.join(reset_runs(features, pieces, rules), "trip_id", "left")
    requested = F.col("requests") >= rules.min_requests
    enabled = F.col("enable_max").isNull() | (F.col("enable_max") >= rules.level)
    hot = [F.col("egt_max") > rules.after_limit, F.col("nox_max") > rules.after_limit]
    if rules.use_filter_temps:
        hot += [F.col("inlet_max") > rules.filter_limit, F.col("outlet_max") > rules.filter_limit]
    thermal = F.lit(False)
    for h in hot:
        thermal = thermal | F.coalesce(h, F.lit(False))
    active = requested & enabled & thermal
    reset = F.coalesce(F.col("longest_run") >= rules.reset_run, F.lit(False))
    empty = F.coalesce(F.col("soot_last") <= rules.soot_empty, F.lit(False))
    cooldown = F.coalesce(F.col("dist_first") < rules.cooldown_below, F.lit(False)) \
        & thermal & ~requested
    post = F.coalesce(F.col("dist_last") < rules.post_below, F.lit(False)) & ~active
    state = (F.when(active & (reset | empty), F.lit("completed"))
             .when(active, F.lit("active"))
             .when(requested & ~thermal, F.lit("requested"))
             .when(post | cooldown, F.lit("post_regen"))
             .otherwise(F.lit("idle")))
    return f.select("trip_id", state.alias("dpf_state"),
                    active.cast("int").alias("dpf_regen_active"),
                    requested.alias("requested"), enabled.alias("enabled"),
                    thermal.alias("thermal"), reset.alias("dist_reset"),
                    cooldown.alias("cooldown"), "soot_last", "dist_last")
