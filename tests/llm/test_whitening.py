"""Whitening: the eigen solver against LAPACK, the query against exact arithmetic, odd inputs."""

import math

import numpy as np
import pytest

from tripweave.llm import op12_whitening as op
from tripweave.llm import queries


def check(v: np.ndarray, k: int, exact: float = 1e-11) -> None:
    values, q = op.leading_components(v, k)
    want = np.linalg.eigvalsh(v)[::-1][:k]
    size = max(np.abs(want).max(), 1e-300)
    assert np.abs(values - want).max() / size < exact
    assert np.abs(q.T @ q - np.eye(k)).max() < exact
    assert np.abs(v @ q - q * values).max() / size < exact


@pytest.mark.parametrize("d", [1, 2, 3, 5, 16, 64, 130])
def test_components_of_random_covariances(d):
    a = np.random.default_rng(d).standard_normal((3 * d, d))
    check(a.T @ a / len(a), min(d, 16))


def test_components_of_clusters_and_of_reducible_matrices():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((64, 64)))
    for e in ([9] * 8 + [8.999999999] * 8 + [1] * 48, [1e8, 1e8 - 1e-6, *10.0 ** -np.arange(62)], [3] * 64):
        check((q * np.array(e, float)) @ q.T, 16)
    check(np.eye(30), 16)
    check(np.ones((40, 40)), 16)
    check(np.kron(np.eye(2), 2 * np.eye(20) + .1), 16)
    r = np.random.default_rng(2)
    for _ in range(100):
        d = r.integers(2, 40)
        a = r.integers(-2, 3, (r.integers(1, 60), d)).astype(float)
        check(np.cov(a.T, ddof=0).reshape(d, d) if len(a) > 1 else np.zeros((d, d)), min(16, d))


def test_sturm_counts_are_eigenvalue_counts():
    r = np.random.default_rng(3)
    main, off = r.standard_normal(12), r.standard_normal(11)
    values = np.linalg.eigvalsh(np.diag(main) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-4, 4, 50)
    assert op.sturm_counts(main, off, at).tolist() == [(values < p).sum() for p in at]


def brute(rows):
    """By the words of the contract, with exact integers for counts, sums and deviations."""
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
              if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n - 1_000_000 for s in sums])
    centred = np.array(fit, float) - 1_000_000 - mean
    v = centred.T @ centred / n
    values, q = np.linalg.eigh(v)
    values, q = values[::-1][:16], q[:, ::-1][:, :16]
    out = {}
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = (np.array(x, float) - 1_000_000 - mean) @ q / np.sqrt(values)
        for c in range(len(values)):
            out.setdefault((i, c + 1), []).append((n, deviation, abs(w[c]), values[c] / np.trace(v)))
    return out


def test_the_query_against_brute_force(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in r.standard_normal(20) * np.arange(1, 21)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]                       # copies count once
    rows += [(7, rows[7][1]), (2000, None), (2001, [None] * 20), (2002, [math.nan] * 20), (2003, [math.inf] + [0.0] * 19)]
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, x int").repartition(5) \
        .write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    signs = {}
    for row in queries.QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).collect():
        got.setdefault((row.vec_id, row.component), []).append((row.n, row.deviation, row.whitened, row.explained))
        assert row.identity_error < 1e-10
        signs.setdefault(row.vec_id, []).append(row.whitened)
    want = brute(rows)
    assert got.keys() == want.keys()
    for key, mine in got.items():
        assert len(mine) == len(want[key])
        for (n, deviation, w, e), (n2, deviation2, w2, e2) in zip(mine, want[key]):
            assert (n, deviation) == (n2, deviation2) and abs(abs(w) - w2) < 1e-9 and abs(e - e2) < 1e-12
    white = np.array([[got[i, c][0][2] for c in range(1, 17)] for i in range(300)])
    assert np.abs(np.cov(white.T, ddof=0) - np.eye(16)).max() < 1e-10          # signs agree over all rows


def test_odd_vectors(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, component int, n int")
        return op.whiten(df).collect()

    assert run([]) == []
    assert run([(1, [1.0, 2.0], "a", 1, 1)] * 3) == []                         # no variance
    assert run([(1, None, "a", 1, 1), (2, [], "a", 1, 1), (None, [1.0], "a", 1, 1)]) == []
    rows = run([(1, [0.0, 1.0], "a", 1, 1), (2, [1.0, 1.0], "a", 1, 1), (3, [1.0], "a", 1, 1), (4, [1e300, 0.0], "a", 1, 1)])
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in rows) \
        == [(1, 1, 2, 64 * 64, 1.0, 1.0), (2, 1, 2, 64 * 64, 1.0, 1.0)]
    big = run([(1, [2.0 ** 45], "a", 1, 1), (2, [-2.0 ** 45], "a", 1, 1), (3, [0.0], "a", 1, 1)])
    assert [r.deviation for r in sorted(big, key=lambda r: r.vec_id)] == [None, None, 0]
    assert all(abs(r.identity_error) < 1e-12 for r in big)
