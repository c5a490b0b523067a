"""The three learned operators: planted signals are found on rows they never learned from; odd inputs are defined."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import prose
from tripweave.llm import op1_quality, op3_language, op10_toxicity


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with a few rude words or with junk symbols, and their labels."""
    r, docs, labels = random.Random(4), [], []
    for i in range(700):
        words = prose(i, r.randrange(40, 200)).split()
        toxic, junk = r.random() < 0.2, r.random() < 0.2
        if toxic:
            for _ in range(max(3, len(words) // 30)):
                words.insert(r.randrange(len(words)), r.choice(["Blorgface", "zumpkin", "grotnik"]))
        if junk:
            words = [w + r.choice(["###", "$$$", "%%%"]) for w in words]
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(not junk), int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_on_rows_not_learned_from(corpus):
    docs, labels = corpus
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r.score for r in op10_toxicity.toxicity(docs, labels).collect()}
    held = [i for i in truth if fold(i, 5) == 0]
    assert len(got) == len(truth) and np.mean([(got[i] >= 0.5) == truth[i] for i in held]) > 0.97
    clean = [i for i in held if not truth[i]]
    assert np.mean([got[i] < 0.5 for i in clean]) > 0.98


def test_held_out_labels_do_not_matter(corpus, spark):
    docs, labels = corpus
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                                1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = op10_toxicity.fit(docs, labels)
    b = op10_toxicity.fit(docs, flipped)
    assert (a.own == b.own).all() and (a.slope, a.offset) == (b.slope, b.offset)


def test_expression_counts_are_documents_per_class(corpus):
    docs, labels = corpus
    rows = op10_toxicity.count_expressions(docs.selectExpr("doc_id", "lower(text) as text").join(labels, "doc_id")).collect()
    by_slot = {r.slot: (r.n_ordinary, r.n_toxic) for r in rows}
    word = np.frombuffer(b"Blorgface".lower(), np.uint8)
    slots, _ = op10_toxicity.expressions(word, np.array([0, len(word)]))
    have = [("blorgface" in r.text.lower(), r.toxic) for r in docs.join(labels, "doc_id").collect()]
    n_toxic = sum(x and t for x, t in have)
    assert by_slot[int(slots[0, -1])][1] >= n_toxic > 0


def test_expressions_do_not_share_counts(spark):
    """More expressions than any table of fixed size had slots: each is counted for itself."""
    letters = np.random.default_rng(1).integers(97, 123, (300_000, 12)).astype(np.uint8)
    letters[:, -1] = 32
    words = sorted(set(letters.tobytes().decode().split()))
    want = {(k, w[:k]) for w in words for k in (*op10_toxicity.PREFIXES, 99)}
    rows = [(" ".join(words[i::200]), i % 2) for i in range(200)]
    counts = op10_toxicity.count_expressions(spark.createDataFrame(rows, "text string, toxic int")).toPandas()
    assert len(want) > 1 << 20 and len(counts) == len(want)
    assert len(counts[(counts.n_ordinary + counts.n_toxic) == 1]) >= len(words)


def test_features_equal_brute_force(corpus):
    docs, labels = corpus
    got = {r.doc_id: r.feature for r in op10_toxicity.score_with(docs, op10_toxicity.fit(docs, labels)).collect()}
    text = {r.doc_id: r.text.lower() for r in docs.collect()}
    words = {i: ["".join(c if c.isalpha() else " " for c in t).split() for t in [t]][0] for i, t in text.items()}
    levels = (*op10_toxicity.PREFIXES, 99)
    n, n_texts = {}, [0, 0]
    for r in labels.collect():
        if fold(r.doc_id, 5) > 1:
            n_texts[r.toxic] += 1
            for x in {(k, w[:k]) for w in words[r.doc_id] for k in levels}:
                n.setdefault(x, [0, 0])[r.toxic] += 1
    n = {x: v for x, v in n.items() if v[1] > 3}              # the vocabulary: discounted toxic mass
    total = [max(sum(v[c] for v in n.values()), 1) for c in (0, 1)]
    left = [1 - sum(max(v[c] - 3, 0) for v in n.values()) / total[c] for c in (0, 1)]

    def gain(w):
        p = [1.0, 1.0]
        for k in levels:
            v = n.get((k, w[:k]))
            if v:
                p = [max(v[c] - 3, 0) / total[c] / (sum(v) / sum(total)) + left[c] * p[c] for c in (0, 1)]
        if (k_last := [k for k in levels if (k, w[:k]) in n]) and p[1] >= 2 * p[0]:
            v = n[k_last[-1], w[:k_last[-1]]]
            usual = sum(v) * n_texts[1] / sum(n_texts)
            return np.log1p(0.02 * (p[1] / p[0] - 1)) if v[1] > usual + 4 * usual ** 0.5 else 0.0
        return 0.0

    assert 0 < sum(gain(w) > 0 for w in {w for ws in words.values() for w in ws}) < 60
    for i, ws in words.items():
        assert abs(got[i] - sum(map(gain, ws)) / max(len(ws), 1)) < 1e-9


def test_whole_models_know_every_expression(spark):
    """Both models count all expressions, so a word of ordinary documents alone is no evidence, whatever its beginning is."""
    r, docs, toxic = random.Random(9), [], {}
    for i in range(600):
        words = [w.lower() for w in prose(i, 60).split()]
        toxic[i] = int(i % 5 == 0)
        word = "zumpkin" if toxic[i] else "zumpkinizing" if i % 20 == 1 else None
        docs.append((i, " ".join(words[:30] + [word] * 3 * (word is not None) + words[30:])))
    docs.append((1000, "zumpkinizing " * 40))
    docs.append((1001, "zumpkinettes " * 40))                       # in no training text: worth what its beginning is
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = op10_toxicity.fit(frame, labels, whole=True)
    got = {r.doc_id: r.feature for r in op10_toxicity.score_with(frame, model).collect()}
    levels = (*op10_toxicity.PREFIXES, 99)
    words = {i: "".join(c if c.isalpha() else " " for c in t).split() for i, t in docs}
    n, n_texts = {}, [0, 0]
    for i, t in toxic.items():
        if fold(i, 5) > 1:
            n_texts[t] += 1
            for x in {(k, w[:k]) for w in words[i] for k in levels}:
                n.setdefault(x, [0, 0])[t] += 1
    total = [sum(v[c] for v in n.values()) for c in (0, 1)]
    left = [1 - sum(max(v[c] - 3, 0) for v in n.values()) / total[c] for c in (0, 1)]
    assert model.total == tuple(total) and model.counts.count() == len(n)

    def gain(w):
        p, last = [1.0, 1.0], None
        for k in levels:
            if v := n.get((k, w[:k])):
                p, last = [max(v[c] - 3, 0) / total[c] / (sum(v) / sum(total)) + left[c] * p[c] for c in (0, 1)], v
        usual = sum(last) * n_texts[1] / sum(n_texts) if last else 0
        strong = last and last[1] > 3 and p[1] >= 2 * p[0] and last[1] > usual + 4 * usual ** 0.5
        return np.log1p(0.02 * (p[1] / p[0] - 1)) if strong else 0.0

    for i, ws in words.items():
        assert abs(got[i] - sum(map(gain, ws)) / max(len(ws), 1)) < 1e-9
    assert got[1000] == 0 < got[1001]


@pytest.mark.parametrize("op", [op10_toxicity.toxicity, op1_quality.quality])
def test_scores_of_odd_inputs(op, edges, nothing, spark):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(8, 1, 1), (7, 0, 0), (4, None, None), (None, 1, 1), (99, 0, 1)],
                                 "doc_id long, quality int, toxic int")
    for labels in (no_labels, some):
        rows = op(edges, labels).collect()
        assert len(rows) == edges.where("doc_id is not null").count()
        assert all(0 <= r.score <= 1 for r in rows)
    assert all(abs(r.score - 0.5) < 1e-9 for r in op(edges, no_labels).collect())
    by_id = {}
    for r in op(edges, some).collect():
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert by_id[1] == by_id[2] and all(len(s) == 1 for s in by_id.values())
    assert op(nothing, some).count() == 0


def test_quality_on_rows_not_learned_from(corpus):
    docs, labels = corpus
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r.score for r in op1_quality.quality(docs, labels).collect()}
    held = [i for i in truth if fold(i, 5) == 0]
    assert np.mean([(got[i] >= 0.3) == truth[i] for i in held]) > 0.97


def test_compiled_rules_equal_numpy(corpus):
    docs, labels = corpus
    model = op1_quality.fit(docs, labels)
    assert 0 < len(model.rules) < 200
    rows = op1_quality.statistics(docs).withColumn("score", model.column()).toPandas()
    x = rows[list(op1_quality.STATISTICS)].to_numpy()
    assert np.allclose(model.scores(x), rows["score"], atol=1e-9)


def test_lasso_keeps_few_weights():
    r = np.random.default_rng(1)
    z = (r.random((2000, 40)) < 0.5).astype(float)
    y = (r.random(2000) < 1 / (1 + np.exp(-(4 * z[:, 3] - 2)))).astype(float)
    _, w = op1_quality.lasso_logistic(z, y, 0.02)
    assert int(np.argmax(np.abs(w))) == 3 and (np.abs(w) > 1e-6).sum() < 10


def test_gradients_of_the_network():
    net = op3_language.Network.new(["a", "b", "c"])
    for k in net.weights:
        net.weights[k] = net.weights[k].astype(np.float64)
    r = np.random.default_rng(2)
    codes = r.integers(0, 256, (5, 6))
    codes[0, 3:] = codes[2, 5:] = 256
    label = np.array([0, 1, 2, 0, 1])
    _, g = net.gradients(codes, label)
    for name, at in (("fx", (int(codes[1, 0]), 4)), ("fh", (2, 20)), ("fh", (2, 40)), ("bh", (3, 5)), ("out", (7, 1)),
                     ("bx", (int(codes[2, 4]), 37)), ("bias", (2,))):
        w, eps = net.weights[name], 1e-3
        keep = w[at]
        w[at] = keep + eps
        up, _ = net.gradients(codes, label)
        w[at] = keep - eps
        down, _ = net.gradients(codes, label)
        w[at] = keep
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-4, name


def test_languages_on_rows_not_learned_from(spark):
    r = random.Random(6)
    syllables = {"aa": "tha ner ing sto rel".split(), "bb": "sch ein ung ver kei".split(), "cc": "eau oix que tre lle".split()}
    rows = []
    for i in range(300):
        lang = r.choice(list(syllables))
        words = ["".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 60))]
        rows.append((i, " ".join(words), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = op3_language.sample(docs)
    assert len(texts) == sum(fold(i, 4) != 2 for i in range(300))
    net = op3_language.train(texts, langs, steps=150)
    got = {r.doc_id: r for r in op3_language.predict(docs, net).collect()}
    held = [(i, x) for i, _, x in rows if fold(i, 4) == 2]
    assert np.mean([got[i].lang_pred == x for i, x in held]) > 0.97
    assert all(0 <= g.score <= 1 for g in got.values())


def test_language_of_odd_inputs(edges, nothing):
    net = op3_language.train(["the cat", "der hund", "le chien"] * 3, ["en", "de", "fr"] * 3, steps=20)
    got = {r.doc_id: r for r in op3_language.predict(edges, net).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 1 for i in (1, 2, 3, 13))
    assert all(got[i].lang_pred in ("en", "de", "fr") for i in (4, 6, 7, 11))
    assert abs(got[8].score - got[9].score) < 1e-5
    assert op3_language.predict(nothing, net).count() == 0
    assert all(r.lang_pred == "und" for r in op3_language.identify(edges.where("lang is null")).collect())


def test_a_run_is_labelled_alike_wherever_it_stands():
    net = op3_language.Network.new(["a", "b"])
    text = b"alpha beta alpha " + b"y" * 40
    data = np.frombuffer(text, np.uint8)
    whole = op3_language.document_probabilities(net, data, np.array([0, len(data)]))
    starts, ends, _ = op3_language.runs(data, np.array([0, len(data)]))
    assert (ends - starts).sum() == sum(not chr(c).isspace() for c in text)
    each = [net.pooled(op3_language.padded(data, starts[i:i + 1], ends[i:i + 1]))[0] for i in range(len(starts))]
    assert np.allclose(whole[0], np.sum(each, axis=0) / np.sum(each), atol=1e-6)
