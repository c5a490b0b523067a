"""Near duplicates, passages, lines, fingerprints and search against brute force; odd inputs are defined."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import EDGES, prose
from tripweave.llm import op2_jaccard, op4_search, op7_passages, op8_fingerprint, op9_lines
from tripweave.llm.hashing import mix
from tripweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, k):
    w = WORD.findall(lowered(text))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else \
        frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def edited(text, r, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"edit{r.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def families():
    """Copies with growing numbers of edits, chains of edits, short texts that share their words."""
    r, rows = random.Random(11), []
    for f in range(25):
        text = prose(100 + f, r.choice([8, 12, 20, 60, 150, 400]))
        rows.append(text)
        for _ in range(r.randrange(6)):
            text = edited(text if r.random() < 0.5 else rows[-1], r, r.randrange(0, 4))
            rows.append(text)
    rows += [prose(5, n) for n in range(1, 30)] + [" ".join(["same"] * n) for n in range(1, 12)]
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard_components(families, spark, k, percent):
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in op2_jaccard.jaccard_components(docs, k, percent).collect())
    assert got == brute_components(families, k, percent)


def test_points_lose_no_link_and_leave_few_documents():
    """Half-equal documents share many keys; their points, a tenth of the sets, tell that they don't link."""
    r = np.random.default_rng(5)
    shared = mix(r.integers(0, 1 << 63, 150))
    sets = [np.unique(np.concatenate([shared, mix(r.integers(0, 1 << 63, 150))])) for _ in range(60)]
    sets += [np.unique(np.concatenate([r.permutation(s)[e:], mix(r.integers(0, 1 << 63, e))]))
             for s, e in zip(sets[:20], range(10, 50, 2))]
    limits = op2_jaccard.bands(80)
    n = np.array([len(s) for s in sets])
    common = set.intersection(*(set(op2_jaccard.schemes_of(k, 80, limits)) for k in n.tolist()))
    for scheme in common:
        g = 1 << max(limits[scheme].bit_length() - 1, 4)
        points = np.array([op2_jaccard.point_of(s, g) for s in sets])
        assert points.nbytes * 8 < sum(s.nbytes for s in sets)
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if op2_jaccard.linked(sets[i], sets[j], 80)]
        assert len(pairs) >= 10
        for sides in (np.zeros(len(sets), int), (np.arange(len(sets)) >= 60).astype(int)):
            able = op2_jaccard.able_rows(points, n, np.arange(len(sets)), sides, 80).tolist()
            assert {i for p in pairs for i in p if not sides.any() or sides[p[0]] != sides[p[1]]} <= set(able)
            assert len(able) <= 45
        assert not len(op2_jaccard.able_rows(points, n, np.zeros(len(sets), int), np.zeros(len(sets), int), 80))
    assert common


def test_blocks_of_points_are_cut_into_cells(families, spark, monkeypatch):
    monkeypatch.setattr(op2_jaccard, "POINTS", 4)
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in op2_jaccard.jaccard_components(docs, 3, 80).collect())
    assert got == brute_components(families, 3, 80)


def test_jaccard_of_odd_inputs(edges, nothing):
    got = sorted(tuple(r) for r in op2_jaccard.jaccard_components(edges, 3, 90).collect())
    assert got == brute_components([(i, t) for i, t, _ in EDGES], 3, 90)
    assert op2_jaccard.jaccard_components(nothing, 3, 90).count() == 0


def test_keys_miss_no_pair():
    """Sets at the threshold share a key, whichever shingles differ."""
    r = np.random.default_rng(3)
    for percent in (80, 90):
        limits = op2_jaccard.bands(percent)
        for _ in range(400):
            n = int(r.integers(4, 400))
            base = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            most = (len(base) * (100 - percent)) // (100 + percent)
            drop, add = (int(r.integers(0, most + 1)) for _ in "ab")
            other = np.union1d(r.permutation(base)[drop:], r.integers(0, 1 << 63, add).astype(np.uint64))
            if op2_jaccard.linked(base, other, percent) and not np.array_equal(base, other):
                (a, need_a), (b, need_b) = (op2_jaccard.keys_of(x, percent, limits) for x in (base, other))
                assert len(np.intersect1d(a, b)) >= max(need_a, need_b, 1)


def test_tree_bound_keeps_all_links():
    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in r.integers(20, 200, 30)]
    sets = [np.union1d(r.permutation(b)[int(len(b) * x):], r.integers(0, 1 << 63, int(len(b) * x)).astype(np.uint64))
            for b in base for x in (0, 0.02, 0.04, 0.08)]
    n = np.array([len(s) for s in sets])
    g = op2_jaccard.n_groups(float(n.mean()))
    points = np.array([np.bincount(op2_jaccard.group_of(s, g), minlength=g) for s in sets])
    tree = op2_jaccard.RTree(points, n)
    for i, s in enumerate(sets):
        found = set(tree.matches(points[i], int(n[i]), 90).tolist())
        assert {j for j, t in enumerate(sets) if op2_jaccard.linked(s, t, 90)} <= found
        assert len(found) < len(sets) / 2


def test_blocks_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(op2_jaccard, "CELL", 8)
    r, text = random.Random(2), prose(50, 100)
    rows = [(i, edited(text, r, 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in op2_jaccard.jaccard_components(docs, 3, 80).collect()) == \
        brute_components(rows, 3, 80)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(149, 200), (7, 7), (500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in [*range(100, 150), 200])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_search_equals_brute_force(spark):
    r = np.random.default_rng(8)
    centres = r.normal(0, 1, (12, 16))
    x = centres[r.integers(0, 12, 900)] + r.normal(0, 0.05, (900, 16))
    x[50:60] = x[40:50]                                   # ties
    rows = [(i, [float(v) for v in v], 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2050, [1.0, None] + [0.0] * 14, 1), (2100, [float("nan")] * 16, 1),
             (2150, [float("inf")] * 16, 1), (2200, [1.0, 2.0], 1), (2201, [3.0, 1.0], 1), (2250, [], 1), rows[100]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows[:900]} | {2200: np.array([256, 512]),
                                                                                 2201: np.array([768, 256]), 2250: np.array([], int)}
    want = []
    for i in q:
        if i % 50 == 0:
            scored = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    assert sorted(tuple(t) for t in op4_search.top_k(vectors).collect()) == sorted(want)
    assert op4_search.top_k(vectors.where("false")).count() == 0


def test_clusters_are_pruned():
    r = np.random.default_rng(9)
    centres = r.normal(0, 100, (16, 8))
    x = np.floor(np.repeat(centres, 400, axis=0) + r.normal(0, 1, (6400, 8))).astype(np.int64)
    best = op4_search.Best(np.arange(0, 6400, 10), np.full(640, np.iinfo(np.int64).min), 5)
    compared = op4_search.dual_search(x[::10], x, np.arange(6400), best)
    full = x[::10] @ x.T
    full[np.arange(640), np.arange(0, 6400, 10)] = np.iinfo(np.int64).min
    assert (np.sort(best.score, axis=1) == np.sort(full, axis=1)[:, -5:]).all()
    assert compared < 0.5 * len(list(_leaves(op4_search.CoverTree(x[::10]).root))) \
        * len(list(_leaves(op4_search.CoverTree(x).root)))


def _leaves(node):
    return [node] if not node["below"] else [x for c in node["below"] for x in _leaves(c)]


def test_planted_passages_are_found(spark):
    r, rows, planted = random.Random(21), [], []
    shared = [prose(900 + i, 51 + 5 * i) for i in range(8)]
    for i in range(80):
        words = prose(2000 + i, r.randrange(80, 300)).split()
        if i % 4 == 0:
            p = shared[(i // 4) % len(shared)]
            if i > 40 and i % 8 == 0:
                p = edited(p, r, len(p.split()) // 25)
            at = r.randrange(len(words))
            words[at:at] = p.split()
            planted.append((i, (i // 4) % len(shared), len(p.split())))
        rows.append((i, "\n".join([" ".join(words[:50]), " ".join(words[50:])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = op7_passages.passages(docs)
    got = found.collect()
    first = {}
    for i, p, n in planted:
        if p not in first:
            first[p] = i
            continue
        hit = [g for g in got if g.doc_id == i and g.source_id == first[p]]
        assert hit and max(g.end - g.start for g in hit) >= 0.9 * n
    assert {g.doc_id for g in got} <= {i for i, *_ in planted}
    left = {x.doc_id: x.text for x in op7_passages.drop_passages(docs, found).collect()}
    for i, text in rows:
        gone = len(text.split()) - len(left[i].split())
        assert gone == 0 if i not in {g.doc_id for g in got} else gone >= 45
    assert not op7_passages.passages(spark.createDataFrame(sorted(left.items()), "doc_id long, text string")).collect()


def test_passages_whose_seeds_occur_earlier_elsewhere(spark):
    rows, want = [], set()
    for i in range(12):
        words = prose(7000 + i, 60).split()
        around = [prose(7500 + 10 * i + j, 80) for j in range(5)]
        if i % 2:                                      # each piece in an earlier document of its own
            rows += [(100 * i + j, f"{a} {' '.join(words[12 * j:12 * j + 14])} {a}") for j, a in enumerate(around)]
        else:                                          # 40 of the words in one earlier document
            rows.append((100 * i, f"{around[0]} {' '.join(words[10:50])}"))
        rows += [(100 * i + 50, f"{prose(7300 + i, 80)} {' '.join(words)}"),
                 (100 * i + 60, f"{' '.join(words)} {prose(7400 + i, 80)}")]
        want.add((100 * i + 60, 100 * i + 50))
    found = op7_passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r.doc_id, r.source_id) for r in found if r.end - r.start >= 55} == want


def test_previous_documents_of_pairs_equal_brute_force(spark, monkeypatch):
    r, rows, places = random.Random(31), [], {}
    for doc in range(300):
        for at in range(6):
            pair = r.choice([1, 2, *range(10, 400)])
            rows.append((0, doc, 20 * at, pair, 5))
            places.setdefault(pair, {}).setdefault(doc, []).append(20 * at)
    want = set()
    for docs in places.values():
        order = sorted(docs)
        for before, doc in zip(order, order[1:]):
            want |= {(doc, at + step, before, docs[before][0] + step) for at in docs[doc] for step in (0, 5)}
    found = spark.createDataFrame(rows, "hash long, doc_id long, at int, pair long, step int").repartition(4)
    for hot in (200, 1, 10 ** 9):                     # the two frequent pairs are dealt by ranges, none, and every pair
        monkeypatch.setattr(op7_passages, "HOT", hot)
        got = op7_passages.previous_matches(found).collect()
        assert len(got) == len({tuple(x) for x in got}) and {tuple(x) for x in got} == want


def test_matches_are_laid_out_once_for_chains(spark):
    twice = spark.createDataFrame([(1, 0, 0, 0, True), (1, 0, 0, 0, False), (1, 30, 0, 30, False)],
                                  "doc_id long, at int, source long, source_at int, by_first boolean")
    out = op7_passages.chained(twice)
    assert [tuple(x) for x in out.collect()] == [(1, 0, [0, 30], [0, 30], True)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan[:plan.find("Initial Plan")].count("Exchange") == 1


def test_chains_equal_brute_force():
    r = random.Random(3)
    for _ in range(60):
        n = r.randrange(1, 12)
        points = sorted({(r.randrange(60), r.randrange(60)) for _ in range(n)})
        x, y = (np.array(c) for c in zip(*points))
        got = op7_passages.chains(x, y)
        assert sorted(k for c in got for k in c) == list(range(len(points)))

        def value(chain):
            return sum(5 - (0.05 * (x[b] - x[a] + y[b] - y[a]) if a is not None else 0)
                       for a, b in zip([None, *chain], chain))

        def best_from(k):
            return max([value([k])] + [value([k]) + best_from(j) - 0.05 * (x[j] - x[k] + y[j] - y[k])
                                       for j in range(len(points)) if x[j] > x[k] and y[j] > y[k]])

        assert abs(value(got[0]) - max(best_from(k) for k in range(len(points)))) < 1e-9


def test_common_subsequence():
    r = random.Random(5)
    for _ in range(200):
        x, y = ([r.randrange(5) for _ in range(r.randrange(14))] for _ in "xy")
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
        assert op7_passages.common_subsequence(np.array(x, int), np.array(y, int)) == table[-1, -1]


def test_passages_of_odd_inputs(edges, nothing):
    found = op7_passages.passages(edges)
    got = {(r.doc_id, r.source_id) for r in found.collect()}
    assert got == {(9, 8), (10, 8)}
    left = op7_passages.drop_passages(edges, found)
    assert left.columns == edges.columns and left.count() == edges.count()
    assert {r.doc_id: r.text for r in left.where("doc_id in (8, 9, 10)").collect()} == {
        8: prose(2, 300), 9: "", 10: ""}
    assert op7_passages.passages(nothing).count() == 0


def test_lines_of_odd_inputs(edges, nothing):
    left = op9_lines.drop_recurring_lines(edges, dropped="gone")
    assert left.columns == [*edges.columns, "gone"] and left.count() == edges.count()
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == sorted(
        (i or -1, t or "") for i, t, _ in EDGES)
    assert op9_lines.drop_recurring_lines(nothing).count() == 0


def test_recurring_lines_go_and_copies_stay(spark):
    r, rows = random.Random(7), []
    for i in range(40):
        lines = [prose(3000 + 10 * i + j, 30) for j in range(4)]
        if i < 20:
            lines.insert(r.randrange(4), f"Page {i} of 900 printed at {i}:00")
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, edited(rows[-1][1].replace("\n", " \n "), r, 1).replace(" \n ", "\n")) for i in range(15)]
    copy = rows[30][1]
    rows += [(200 + i, copy) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.text, x.gone) for x in op9_lines.drop_recurring_lines(docs, dropped="gone").collect()}
    for i, text in rows:
        want = "\n".join(x for x in text.split("\n") if not x.startswith("Page"))
        assert got[i] == (want, int(i < 20))


@pytest.mark.parametrize("notice", [3, 60])       # a short line, and the longest one of its documents
def test_many_copies_do_not_keep_a_recurring_line(spark, notice):
    r, shared = random.Random(8), prose(9000, notice) + " notice"
    copy = [prose(9100 + j, 30) for j in range(4)]
    rows = [(i, "\n".join([*copy, shared])) for i in range(60)]
    rows += [(100 + i, "\n".join([prose(9200 + 5 * i + j, 20) for j in range(i % 4 + 1)] + [shared])) for i in range(40)]
    for i in range(60):
        lines = list(copy)
        lines[i % 4] = edited(lines[i % 4], r, 3)
        rows.append((200 + i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = op9_lines.drop_recurring_lines(docs, dropped="gone", each_family_once=True)
    got = {x.doc_id: (x.text, x.gone) for x in left.collect()}
    for i, text in rows:
        assert got[i] == ("\n".join(x for x in text.split("\n") if x != shared), int(i < 200)), i


def test_copies_stay_when_each_family_counts_once(spark):
    rows = [(i, "\n".join(prose(9500 + j, 25) for j in range(4))) for i in range(30)]
    rows += [(100 + i, prose(9600, 12)) for i in range(30)] + [(200, None), (201, ""), (202, "\n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = op9_lines.drop_recurring_lines(docs, dropped="gone", each_family_once=True)
    assert {x.doc_id: (x.text, x.gone) for x in left.collect()} == {i: (t, 0) for i, t in rows}


def test_next_documents_and_edited_texts(edges, spark):
    for buckets in (1, 2, 7):
        rows = op8_fingerprint.with_next(edges.where("doc_id <> 5"), buckets=buckets).collect()
        got = {r.doc_id: r for r in rows}
        order = sorted(((i, t or "") for i, t, _ in EDGES if i is not None and i != 5), reverse=True)
        assert len(rows) == len(order)
        for n, (i, text) in enumerate(order):
            k = len(text) // 3
            follow = order[(n + 1) % len(order)][1]
            assert got[i].edited == text[:len(text) - k] + follow[:k] and got[i].n_chars == len(text)
    assert got[8].fingerprint == got[9].fingerprint and got[9].near_next == 1
    assert got[1].fingerprint == "" and 0.3 < got[7].near_edited < 0.7 and got[7].near_next == 0
    alone = op8_fingerprint.with_next(edges.where("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert len(op8_fingerprint.with_next(edges.where("doc_id = 5")).collect()) == 2
    assert op8_fingerprint.with_next(edges.where("false")).count() == 0


def test_sketches_estimate_likeness_and_containment():
    r = random.Random(1)
    long, part = prose(70, 20_000), None
    words = long.split()
    part = " ".join(words[3000:6000])
    a, b = (op8_fingerprint.sketches(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
            for t in (long, part))
    assert op8_fingerprint.containment(b, a) > 0.99 and abs(op8_fingerprint.containment(a, b) - 0.15) < 0.02
    assert abs(op8_fingerprint.likeness(a, b) - 0.15) < 0.02
    assert abs(len(a[1]) / len(shingles(long, 5)) - 1 / 8) < 0.01
    both = op8_fingerprint.merge(a, b)
    assert np.array_equal(both[1], a[1]) and op8_fingerprint.likeness(both, a) == 1
    text = op8_fingerprint.as_text(b)
    assert op8_fingerprint.as_text(op8_fingerprint.from_text(text)) == text
    short = [op8_fingerprint.sketches(np.frombuffer(prose(s, 5).encode(), np.uint8),
                                      np.array([0, len(prose(s, 5).encode())]))[0] for s in range(40)]
    assert all(len(s[1]) for s in short) and any(s[0] for s in short)
    assert all(op8_fingerprint.likeness(short[0], s) == 0 for s in short[1:])
    assert hashlib.sha256(text.encode()).hexdigest() and r


def test_plain_fingerprints_agree(edges):
    plain = {r.doc_id: r.fingerprint for r in op8_fingerprint.fingerprints(edges).collect()}
    for r in op8_fingerprint.with_next(edges).collect():
        assert plain[r.doc_id] == r.fingerprint
