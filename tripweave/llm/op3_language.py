"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a run of bytes without white space (longer runs in stretches of ``LONGEST`` bytes) in both directions
and labels every position; a document's probability of a language is the mean over all its positions. As the state
starts anew with each run, a run that occurs again in a batch is read once and its labels counted again: every
position of every whole text is labelled at a fraction of the passes.

It is trained in NumPy by backpropagation through time on a bounded sample of labelled documents
(``SAMPLE_DOCS``; runs are drawn as often as they occur), on the driver; the weights are a few kilobytes.

Cases: null texts, and texts without a letter, are ``und`` with score 1; a language seen only in the fold left out can't
be predicted; without any labelled row every text is ``und`` with score 0. Repeated rows give equal predictions and
ties go to the language that sorts first. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import slices, text_buffer, texts
from tripweave.llm.hashing import SPACE, word_hashes, word_spans

LONGEST = 16
HIDDEN = 16
SAMPLE_DOCS = 1200
STEPS = 700
_BATCH = 512
_SLICE = 16 << 20
UNKNOWN = "und"


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the stretches the network reads."""
    starts, ends, rows = word_spans(data, bounds, SPACE)
    n = -(-(ends - starts) // LONGEST)
    if len(n) and n.max() > 1:
        first = np.repeat(starts, n)
        step = np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        starts, ends, rows = first + step * LONGEST, np.minimum(np.repeat(ends, n), first + (step + 1) * LONGEST), \
            np.repeat(rows, n)
    return starts, ends, rows


def padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of each run, one row each; 256 after its end."""
    size = ends - starts
    at = np.arange(size.max() if len(size) else 0)
    inside = at[None, :] < size[:, None]
    index = np.minimum(starts[:, None] + at[None, :], max(len(data) - 1, 0))
    return np.where(inside, data[index].astype(np.int64), 256) if len(size) else np.zeros((0, 0), np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights of both directions and of the labels. ``inputs``: what a byte adds to update, reset and candidate."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, languages: list[str], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"{d}x"] = (r.normal(0, 0.3, (257, 3 * HIDDEN))).astype(np.float32)
            w[f"{d}h"] = (r.normal(0, HIDDEN ** -0.5, (HIDDEN, 3 * HIDDEN))).astype(np.float32)
        w["out"] = r.normal(0, 0.2, (2 * HIDDEN, len(languages))).astype(np.float32)
        w["bias"] = np.zeros(len(languages), np.float32)
        return cls(languages, w)

    def _direction(self, d: str, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States at all positions, [time, run, HIDDEN]; a run's state stays as it is after its end."""
        wx, wh = self.weights[f"{d}x"], self.weights[f"{d}h"]
        n, longest = codes.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.zeros((longest, n, HIDDEN), np.float32)
        for t in range(longest) if d == "f" else range(longest - 1, -1, -1):
            code = codes[:, t]
            x = wx[code]
            gates = _sigmoid(x[:, :2 * HIDDEN] + h @ wh[:, :2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN:] + (r * h) @ wh[:, 2 * HIDDEN:])
            live = (code < 256)[:, None]
            if keep is not None:
                keep.append((t, h, z, r, c, live))
            h = np.where(live, h + z * (c - h), h)
            states[t] = h
        return states

    def _labels(self, both: np.ndarray) -> np.ndarray:
        a = both @ self.weights["out"] + self.weights["bias"]
        a = np.exp(a - a.max(axis=-1, keepdims=True))
        return a / a.sum(axis=-1, keepdims=True)

    def pooled(self, codes: np.ndarray) -> np.ndarray:
        """Sum over its positions of each run's label probabilities."""
        both = np.concatenate([self._direction("f", codes), self._direction("b", codes)], axis=2)
        return (self._labels(both) * (codes.T < 256)[:, :, None]).sum(axis=0)

    def gradients(self, codes: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradients, backwards through time."""
        kept = {"f": [], "b": []}
        both = np.concatenate([self._direction(d, codes, kept[d]) for d in "fb"], axis=2)
        p = self._labels(both)
        live = (codes.T < 256)
        n = max(int(live.sum()), 1)
        rows = np.arange(codes.shape[0])
        loss = -float((np.log(p[:, rows, label] + 1e-9) * live).sum()) / n
        da = p.copy()
        da[:, rows, label] -= 1
        da *= live[:, :, None] / np.float32(n)
        g = {"out": np.einsum("tnh,tnk->hk", both, da, optimize=True), "bias": da.sum(axis=(0, 1))}
        dboth = da @ self.weights["out"].T
        for i, d in enumerate("fb"):
            wh = self.weights[f"{d}h"]
            gx, gh = np.zeros_like(self.weights[f"{d}x"]), np.zeros_like(wh)
            dh = np.zeros((codes.shape[0], HIDDEN), np.float32)
            for t, h, z, r, c, on in reversed(kept[d]):
                dh = dh + dboth[t, :, i * HIDDEN:(i + 1) * HIDDEN]
                go = dh * on
                dc = go * z * (1 - c * c)
                drh = dc @ wh[:, 2 * HIDDEN:].T
                dz, dr = go * (c - h) * z * (1 - z), drh * h * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], axis=1)
                np.add.at(gx, codes[:, t], dx)
                gh[:, :2 * HIDDEN] += h.T @ dx[:, :2 * HIDDEN]
                gh[:, 2 * HIDDEN:] += (r * h).T @ dc
                dh = np.where(on, go * (1 - z) + drh * r + dx[:, :2 * HIDDEN] @ wh[:, :2 * HIDDEN].T, dh)
            g[f"{d}x"], g[f"{d}h"] = gx, gh
        return loss, g


def train(texts_of: list[str], langs: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """A network for the labels in ``langs``, by Adam on batches of runs, languages equally often."""
    names = sorted(set(langs))
    net = Network.new(names, seed)
    raw = [t.encode() for t in texts_of]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    starts, ends, rows = runs(data, bounds)
    if not len(starts):
        return net
    label = np.array([names.index(x) for x in langs])[rows]
    of = [np.flatnonzero(label == k) for k in range(len(names))]
    of = [x for x in of if len(x)]
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([r.choice(x, _BATCH // len(of)) for x in of])
        _, g = net.gradients(padded(data, starts[pick], ends[pick]), label[pick])
        rate = 0.02 * (1 - 0.9 * step / steps)
        for k, w in net.weights.items():
            m[k] += 0.1 * (g[k] - m[k])
            v2[k] += 0.01 * (g[k] ** 2 - v2[k])
            w -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def document_probabilities(net: Network, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """[documents, languages]: mean over all positions; a text without any has equal shares."""
    n, k = len(bounds) - 1, len(net.languages)
    starts, ends, rows = runs(data, bounds)
    total = np.zeros((n, k))
    if len(starts):
        _, first, same = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        each = np.zeros((len(first), k), np.float32)
        order = np.argsort(ends[first] - starts[first], kind="stable")     # runs of like length together
        for i in range(0, len(order), 4096):
            at = first[order[i:i + 4096]]
            each[order[i:i + 4096]] = net.pooled(padded(data, starts[at], ends[at]))
        for j in range(k):
            total[:, j] = np.bincount(rows, each[same, j], n)
    all_of = total.sum(axis=1, keepdims=True)
    return np.where(all_of > 0, total / np.where(all_of > 0, all_of, 1), 1 / k)


def sample(docs: DataFrame, folds: int = 4, test_fold: int = 2, most: int = SAMPLE_DOCS) -> tuple[list, list]:
    """Texts and languages of at most ``most`` documents outside the test fold, spread by a hash of the id."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    ids = (docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != test_fold))
           .select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct())
    rows = docs.join(F.broadcast(ids), "doc_id").where("lang is not null and text is not null") \
        .select("doc_id", "text", "lang")
    got = rows.limit(2 * most).collect()
    got.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return [r.text for r in got], [r.lang for r in got]


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    rows = texts(docs).withColumn("letters", F.expr(r"text rlike '\\p{L}'"))
    if net is None or not net.languages:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)     # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            got = [document_probabilities(shared.value, data, offsets[lo:hi + 1])
                   for lo, hi in slices(offsets, _SLICE)]
            p = np.concatenate([*got, np.zeros((0, len(names) - 1))])
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(letters, p.argmax(axis=1), len(names) - 1)
            score = np.where(letters, p.max(axis=1), 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))],
                ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, **how) -> DataFrame:
    """Train on the documents' own labels outside the test fold, then label every document."""
    train_texts, langs = sample(docs, **how)
    return predict(docs, train(train_texts, langs) if langs else None)
