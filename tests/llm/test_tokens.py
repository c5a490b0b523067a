"""BPE and packing: equal to the libraries, exact round trips, odd inputs."""

import random
import zlib

import numpy as np
import public_tokenizers as vocab
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES, prose
from tripweave.llm import op5_packing, op6_bpe

RANKS = vocab.path("byte_bpe_50k.tiktoken")
JSON = vocab.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=op6_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def tree():
    return op6_bpe.encoder(RANKS, vocab.PATTERN)


def test_random_texts_encode_as_the_library_does(tree, library):
    r = random.Random(5)
    letters = "ab'st \n\t  12é!?\x1c\x85　中\U0001f600s,.“  _"
    for _ in range(2000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(60))) * r.choice([1, 1, 3])
        ids = tree.encode(text)
        assert list(np.frombuffer(ids, "<u4")) == library.encode_ordinary(text), text
        assert tree.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 4097, "ab" * 3000 + "c", "x" * 500 + " " * 900 + "y", "é" * 2000,
                                  "0123456789" * 500, prose(3, 3000)], ids=range(6))
def test_long_runs(tree, library, text):
    assert list(np.frombuffer(tree.encode(text), "<u4")) == library.encode_ordinary(text)


def test_join_is_the_encoding_of_both_sides(tree):
    r = random.Random(9)
    for _ in range(2000):
        raw = bytes(r.choice(b"thanded") for _ in range(r.randrange(2, 40)))
        cut = r.randrange(len(raw) + 1)
        whole = op6_bpe.merge_bytes(raw, tree.ranks)
        assert tree.join(op6_bpe.merge_bytes(raw[:cut], tree.ranks), op6_bpe.merge_bytes(raw[cut:], tree.ranks)) == whole
        assert tree.fragment(raw) == whole


def test_encode_and_decode_edges(edges, nothing, library):
    rows = op6_bpe.decode(op6_bpe.encode(edges, RANKS, vocab.PATTERN), RANKS, vocab.PATTERN).collect()
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in rows)
    want = []
    for i, t, _ in EDGES:
        if i is not None:
            ids = library.encode_ordinary(t or "")
            want.append((i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    assert got == sorted(want)
    assert op6_bpe.encode(nothing, RANKS, vocab.PATTERN).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000])
def test_binary_lengths(n):
    parts = op5_packing.binary_lengths(n)
    assert sum(parts) == n and max(parts) <= 2048 and all(p & (p - 1) == 0 for p in parts)
    assert len(parts) == n // 2048 + (n % 2048).bit_count()


def test_pieces_hold_every_id_once(edges, nothing):
    tokenizer = Tokenizer.from_file(JSON)
    rows = op5_packing.pack(edges, JSON).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in rows)
    pieces = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    for i, t, _ in EDGES:
        if i is None:
            continue
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        copies = sum(j == i for j, *_ in EDGES)
        assert all(n == len(ids) for *_, n in pieces[i])
        mine = sorted(pieces[i])[::copies]
        assert b"".join(p for _, p, _ in mine) == np.array(ids, "<u4").tobytes()
    assert op5_packing.pack(nothing, JSON).count() == 0


def test_added_tokens_are_matched_as_the_library_does(spark):
    tokenizer, token, r = Tokenizer.from_file(JSON), "<|endoftext|>", random.Random(12)
    assert 50256 in tokenizer.encode(token, add_special_tokens=False).ids
    bits = [token, token, token[:-1], token[1:], "<|", "|>", " ", "\n", "a", "end", "é", "　", "'s", "1", ".", "<"]
    rows = [token, token * 3, f"a{token}b", f" {token} ", f"{token}\n\n{token}  x", "<|endoftext", "|>"]
    rows = list(enumerate(rows + ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(1500)]))
    got = {}
    for p in op5_packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), JSON).collect():
        got.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
    for i, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert b"".join(x for _, x in sorted(got[i])) == np.array(ids, "<u4").tobytes(), text


def test_buckets_have_one_length(edges, spark, tmp_path):
    op5_packing.write_buckets(op5_packing.pack(edges, JSON), str(tmp_path / "b"))
    read = spark.read.parquet(str(tmp_path / "b"))
    assert read.where("octet_length(ids) <> 4 * length").count() == 0 and read.count() > 0


def test_crc_of_a_piece(edges):
    from pyspark.sql import functions as F

    row = op5_packing.pack(edges.where("doc_id = 8"), JSON).select("ids", F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(bytes(row.ids))


def test_packing_holds_little_at_once():
    import tracemalloc

    import pyarrow as pa

    texts = [prose(i, 400) for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    next(op5_packing._pieces_of(batch.slice(0, 1), JSON, 2048, 1))        # reads the vocabulary
    tracemalloc.start()
    tokens = sum(sum(out.column("length").to_pylist()) for out in op5_packing._pieces_of(batch, JSON, 2048, 1))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens > len(texts) * 400 and most < 150e6
