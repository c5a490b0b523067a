"""Quality by a sparse rule ensemble: tree paths as conjunctive rules over text statistics, weighted by the lasso.

Small boosted trees are grown on statistics of labelled documents; every path from a root is a rule (a conjunction of
comparisons). A logistic model with an L1 penalty keeps few of them, and these are compiled into one Spark column
expression: scoring runs inside the JVM on every whole text, without Python and without a shuffle.

Statistics of at most ``SAMPLE_ROWS`` labelled documents reach the driver (numbers only), where trees and weights are
fitted with NumPy.

Cases: null and empty texts have statistics of 0 and the score those get; null labels don't teach; without labels, or
with one class, the score is the share of label 1 (0.5 without labels); repeated rows score alike. Other input
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import texts

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, LEAST_ROWS = 40, 3, 24, 10
PENALTY = 0.002

STATISTICS = ("log_chars", "upper", "symbols", "bars", "bangs", "digits", "stops", "word_chars", "distinct_words",
              "log_line_chars", "distinct_lines")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``STATISTICS``, all doubles without nulls."""
    text = F.col("text")
    n = F.length(text)

    def without(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    def count(mark: str) -> Column:
        return n - F.length(F.replace(text, F.lit(mark), F.lit("")))

    cut = texts(docs).select(
        "doc_id", n.alias("n"), F.split(text, " ").alias("words"), F.split(text, "\n").alias("lines"),
        without(r"[^\p{Lu}]+").alias("upper"), without(r"[^#$%&*@^~<>={}\[\]\\/_+]+").alias("symbols"),
        without(r"[^0-9]+").alias("digits"), count("|").alias("bars"), count("!").alias("bangs"),
        count(".").alias("stops"))
    counted = cut.select(
        "doc_id", "n", "upper", "symbols", "digits", "bars", "bangs", "stops",
        F.size("words").alias("words"), F.size(F.array_distinct("words")).alias("different_words"),
        F.size("lines").alias("lines"), F.size(F.array_distinct("lines")).alias("different_lines"))
    chars = F.greatest(F.col("n"), F.lit(1))
    return counted.select(
        "doc_id", F.log1p(F.col("n")).alias("log_chars"),
        *[(F.col(c) / chars).alias(c) for c in ("upper", "symbols", "bars", "bangs", "digits", "stops")],
        (F.col("n") / F.col("words")).alias("word_chars"),
        (F.col("different_words") / F.col("words")).alias("distinct_words"),
        F.log1p(F.col("n") / F.col("lines")).alias("log_line_chars"),
        (F.col("different_lines") / F.col("lines")).alias("distinct_lines"))


Condition = tuple[int, bool, float]      # statistic, whether above, threshold
Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, at in rule:
        out &= (x[:, k] > at) if above else (x[:, k] <= at)
    return out


def _thresholds(x: np.ndarray) -> list[np.ndarray]:
    out = []
    for k in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def _grow(x, bins, cuts, gradient, rows, path, found) -> np.ndarray:
    """Fit one regression tree to the gradient; adds every path to ``found`` and returns the fitted values."""
    value = np.zeros(len(x))
    value[rows] = gradient[rows].mean() if len(rows) else 0
    if len(path) == DEPTH or len(rows) < 2 * LEAST_ROWS:
        return value
    g, best = gradient[rows], (1e-9, 0, 0)
    for k in range(x.shape[1]):
        if not len(cuts[k]):
            continue
        n = np.cumsum(np.bincount(bins[rows, k], minlength=len(cuts[k]) + 1))[:-1]
        s = np.cumsum(np.bincount(bins[rows, k], g, len(cuts[k]) + 1))[:-1]
        m, total = len(rows) - n, g.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s ** 2 / n + (total - s) ** 2 / m - total ** 2 / len(rows)
        gain[(n < LEAST_ROWS) | (m < LEAST_ROWS)] = -1
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (gain[at], k, at)
    gain, k, at = best
    if gain <= 1e-9:
        return value
    above = bins[rows, k] > at
    for side in (False, True):
        rule = (*path, (k, side, float(cuts[k][at])))
        found.setdefault(tuple(sorted(rule)), None)
        value_side = _grow(x, bins, cuts, gradient, rows[above == side], rule, found)
        value[rows[above == side]] = value_side[rows[above == side]]
    return value


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[Rule]:
    """Paths of trees boosted on the logistic loss, each on half of the rows."""
    cuts = _thresholds(x)
    bins = np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)])
    r, found = np.random.default_rng(seed), {}
    f = np.zeros(len(x))
    for _ in range(TREES):
        gradient = y - 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(r.random(len(x)) < 0.5)
        f += 2.0 * _grow(x, bins, cuts, gradient, rows, (), found)
    return list(found)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient; columns of ``z`` are 0 or 1."""
    n, d = z.shape
    centre = z.mean(axis=0)
    a = (z - centre).astype(np.float64)
    rate = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = v = np.zeros(d)
    share = (y.sum() + 0.5) / (n + 1)
    b = vb = np.log(share / (1 - share))
    t = 1.0
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-np.clip(a @ v + vb, -30, 30))) - y
        new = v - rate * (a.T @ gap) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = vb - 2.0 * gap.mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return float(b - centre @ w), w


@dataclass
class RuleEnsemble:
    base: float
    rules: list[tuple[float, Rule]]

    def column(self) -> Column:
        """The probability of label 1 as a column over ``STATISTICS``."""
        total = F.lit(self.base)
        for weight, rule in self.rules:
            holds = None
            for k, above, at in rule:
                one = F.col(STATISTICS[k]) > F.lit(at) if above else F.col(STATISTICS[k]) <= F.lit(at)
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for weight, rule in self.rules:
            total += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleEnsemble:
    share = (y.sum() + 1) / (len(y) + 2)
    constant = RuleEnsemble(float(np.log(share / (1 - share))), [])
    if not len(y) or y.min() == y.max():
        return constant
    rules = tree_rules(x, y)
    if not rules:
        return constant
    base, weights = lasso_logistic(np.column_stack([_holds(r, x) for r in rules]).astype(np.float64), y, penalty)
    return RuleEnsemble(base, [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, test_fold: int = 0,
        sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Learn from at most ``sample_rows`` labelled rows outside the test fold, spread by a hash of the id."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where(F.col("quality").isin(0, 1) & (fold != test_fold))
             .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows))
    few = F.broadcast(known)                                  # at most sample_rows rows of two numbers
    chosen = docs.join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = statistics(chosen).join(few, "doc_id").select(*STATISTICS, "quality", "doc_id").toPandas()
    rows = rows.sort_values(["doc_id", "quality", *STATISTICS], kind="stable")
    return fit_rules(rows[list(STATISTICS)].to_numpy(np.float64), rows["quality"].to_numpy(np.float64))


def quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id and the probability ``score`` that the document is good."""
    return statistics(docs).select("doc_id", fit(docs, labels, **how).column().alias("score"))
