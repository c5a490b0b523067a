"""Alignment of two tokenizers: every column of the query against brute force, odd inputs, pointers."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as vocab
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES, prose
from tripweave.llm import op13_alignment as op
from tripweave.llm import queries
from tripweave.llm.op11_pair_bpe import byte_letters

A_PATH, B_PATH = vocab.path("byte_bpe_50k.json"), vocab.path("piece_bpe_32k.model")
LETTER = {c: b for b, c in enumerate(byte_letters())}


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(A_PATH)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def spans(raws):
    at, out = 0, []
    for raw in raws:
        out.append((at, at + len(raw)))
        at += len(raw)
    return out


def brute(text, libraries):
    """Ids, groups and links of one text by comparing all tokens with all, or None."""
    first, second = libraries
    if not text:
        return None
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    raw_a = [bytes(LETTER[c] for c in first.id_to_token(i)) for i in a]
    raw_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i)
             else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    at_a, at_b = spans(raw_a), spans(raw_b)
    links = []
    for i, (s, e) in enumerate(at_a):
        links += [(a[i], b[j]) for j, (u, v) in enumerate(at_b) if s < v and u < e]
    groups, start = [], 0
    for cut in sorted({e for _, e in at_a} & {e for _, e in at_b}):
        groups.append("|".join(",".join(str(x) for x, (s, e) in zip(ids, at) if start <= s and e <= cut)
                               for ids, at in ((a, at_a), (b, at_b))))
        start = cut
    return len(a), len(b), ";".join(groups), links


def table(texts, libraries):
    found = [(i, brute(t, libraries)) for i, t in texts]
    count = Counter()
    for _, f in found:
        count.update(set(f[3]) if f else ())
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    rows = []
    for i, f in found:
        if f is None:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            rows.append((i, n_a, n_b, groups.count(";") + 1, len(links), sum(count[x] == top[x[0]] for x in links),
                         sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(rows)


def random_texts(n, seed=3):
    r = random.Random(seed)
    bits = [*"ab'st \n\t  12é!?\x1c\x85　中\U0001f600s,.“  _aaaa", "<|endoftext|>", "<s>", "<0x41>", "▁", "the", "ing",
            " the", " and", "ﬁ", "Ж", "\r\n", "don't", "naïve", "\xa0"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(n)]


def test_the_query_against_brute_force(spark, libraries, tmp_path):
    texts = list(enumerate(random_texts(1200))) + [(i, t) for i, t, _ in EDGES if i is not None and len(t or "") < 5000]
    texts += [(7000 + i, prose(2, 300)) for i in range(30)]        # copies
    rows = [(i, t, 1, 2) for i, t in texts] + [(None, "no id", 1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, a int, slice int").repartition(9) \
        .write.parquet(str(tmp_path / "documents.parquet"))        # a slice lies in one file, so counts come from many
    got = queries.QUERIES["op13_tokenizer_alignment"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == table(texts, libraries)


def test_long_texts_and_edges(edges, nothing, spark):
    rows = {}
    for r in op.align(edges, A_PATH, B_PATH).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sorted(rows) == sorted({i for i, *_ in EDGES if i is not None}) and len(rows[5]) == 2
    for i, t, _ in EDGES:
        if i is not None and not t:
            assert (rows[i][0].n_a, rows[i][0].n_b, rows[i][0].groups, rows[i][0].count_sum) == (0, 0, "", 0)
    long = rows[7][0]
    assert long.n_groups == long.groups.count(";") + 1 and long.n_links >= max(long.n_a, long.n_b)
    assert op.align(nothing, A_PATH, B_PATH).count() == 0


def test_parts_are_encoded_as_whole_texts_are(libraries):
    first, second = libraries
    both = op.PairOfTokenizers(A_PATH, B_PATH, most=200)           # a memory that overflows
    texts = [" " + t for t in random_texts(1500, seed=11)] + [" " + "x" * 3000, " " + prose(4, 2000)]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    (a, a_rows), (b, b_rows) = both.ids(data, bounds)
    for i, t in enumerate(texts):
        assert a[a_rows[i]:a_rows[i + 1]].tolist() == first.encode(t, add_special_tokens=False).ids
        if len(t) > 1:
            assert b[b_rows[i]:b_rows[i + 1]].tolist() == second.encode(t[1:])


def test_pointers_of_long_chains_meet_at_the_terminal():
    n = 5000
    pointer = np.minimum(np.arange(n) + 1, (np.arange(n) // 1000) * 1000 + 999)
    assert op.jump(pointer).tolist() == ((np.arange(n) // 1000) * 1000 + 999).tolist()
    a_end, b_end = np.arange(2, 4002, 2), np.append(np.arange(1, 3999, 2), 4000)   # a chain over the whole text
    lo, hi = op.overlaps(a_end, b_end)
    for label in op.terminals(a_end, b_end, lo, hi):
        assert set(label.tolist()) == {4000}
