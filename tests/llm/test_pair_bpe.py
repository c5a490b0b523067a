"""BPE by pair positions: equal to the tokenizers library, odd inputs, the query's digests."""

import hashlib
import random

import numpy as np
import public_tokenizers as vocab
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES, prose
from tripweave.llm import op11_pair_bpe as op
from tripweave.llm import queries

JSON = vocab.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def mine():
    return op.encoder(JSON, vocab.PATTERN)


def test_random_texts_encode_and_decode_as_the_library_does(mine, library):
    r = random.Random(5)
    bits = [*"ab'st \n\t  12é!?\x1c\x85　中\U0001f600s,.“  _aaaa", "<|endoftext|>", "<|endoftext|>", "<|endoftext", "the"]
    for _ in range(2000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(60))) * r.choice([1, 1, 3])
        want = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == want, text
        assert mine.vocabulary.decode(want)[0].tobytes().decode() == library.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 4097, "ab" * 3000 + "c", "x" * 500 + " " * 900 + "y", "é" * 2000,
                                  "0123456789" * 500, prose(3, 3000), "aaa" * 7 + "b" + "aaaa" * 5], ids=range(7))
def test_long_runs(mine, library, text):
    assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_any_ids_decode_as_the_library_does(mine, library):
    r = random.Random(2)
    for _ in range(300):
        ids = [r.randrange(50_400) for _ in range(30)]             # some are unknown, most are no UTF-8 together
        got = mine.vocabulary.decode(np.array(ids))[0].tobytes().decode(errors="replace")
        assert got == library.decode(ids, skip_special_tokens=False)


def test_the_index_merges_all_words_of_a_batch_as_each_alone(mine):
    r = random.Random(8)
    words = [bytes(r.choice(b"thanded ") for _ in range(r.randrange(0, 30))) for _ in range(500)]
    ids, n = op.PairIndex(words, mine.vocabulary).run()
    cuts = np.concatenate([[0], np.cumsum(n)])
    for i, w in enumerate(words):
        alone, _ = op.PairIndex([w], mine.vocabulary).run()
        assert ids[cuts[i]:cuts[i + 1]].tolist() == alone.tolist()
    assert not op.PairIndex([], mine.vocabulary).run()[0].size


def test_a_vocabulary_with_other_order_or_kind_is_refused(tmp_path):
    import json

    with open(JSON, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"type": "WordPiece"}, {"merges": spec["model"]["merges"][::-1]}):
        path = tmp_path / "v.json"
        path.write_text(json.dumps({**spec, "model": {**spec["model"], **change}}), encoding="utf-8")
        with pytest.raises(ValueError):
            op.Vocabulary(str(path))


def test_edges(edges, nothing, library):
    rows = op.decode(op.encode(edges, JSON, vocab.PATTERN), JSON, vocab.PATTERN).collect()
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in rows)
    want = []
    for i, t, _ in EDGES:
        if i is not None:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), np.array(ids, "<u4").tobytes(), t or ""))
    assert got == sorted(want)
    assert op.decode(op.encode(nothing, JSON, vocab.PATTERN), JSON, vocab.PATTERN).count() == 0


def test_the_query_against_the_library(spark, edges, library, tmp_path):
    edges.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.QUERIES["op11_pair_index_bpe"](spark, str(tmp_path)).collect()))
    want = []
    for i, t, _ in EDGES:
        if i is not None:
            ids = library.encode(t or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
