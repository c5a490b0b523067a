"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import (op1_quality, op2_jaccard, op3_language, op4_search, op5_packing, op6_bpe,
                           op7_passages, op8_fingerprint, op9_lines, op10_toxicity, op11_pair_bpe, op12_whitening,
                           op13_alignment)
from tripweave.llm.common import documents, held_out, labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_rule_quality(spark, sf_dir):
    scored = op1_quality.quality(documents(spark, sf_dir), labels(spark, sf_dir), folds=5, test_fold=0)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_count_vector_rtree(spark, sf_dir):
    return op2_jaccard.jaccard_components(documents(spark, sf_dir), k=3, percent=90)


ORACLES["op2_count_vector_rtree"] = op2_jaccard.ORACLE


@query
def op3_language_id(spark, sf_dir):
    found = op3_language.identify(documents(spark, sf_dir), folds=4, test_fold=2)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


@query
def op4_dual_tree_search(spark, sf_dir):
    return op4_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


ORACLES["op4_dual_tree_search"] = op4_search.ORACLE


@query
def op5_binary_packing(spark, sf_dir):
    packed = op5_packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query
def op6_tree_bpe(spark, sf_dir):
    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    done = op6_bpe.decode(op6_bpe.encode(documents(spark, sf_dir), *how), *how)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_chained_passages(spark, sf_dir):
    return op7_passages.passages(documents(spark, sf_dir)).select(
        "doc_id", "start", "end", "source_id", "source_start", "source_end", "same")


@query
def op8_scaled_sketch(spark, sf_dir):
    return op8_fingerprint.with_next(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next")


@query
def op9_log_templates(spark, sf_dir):
    return op9_lines.drop_recurring_lines(documents(spark, sf_dir), dropped="n_dropped").select(
        "doc_id", "text", "n_dropped")


ORACLES["op9_log_templates"] = op9_lines.ORACLE_LINES


@query
def op10_kneser_ney_toxicity(spark, sf_dir):
    scored = op10_toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir), folds=5, test_fold=0, whole=True)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op11_pair_index_bpe(spark, sf_dir):
    how = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    done = op11_pair_bpe.decode(op11_pair_bpe.encode(documents(spark, sf_dir), *how), *how)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_embedding_whitening(spark, sf_dir):
    return op12_whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_tokenizer_alignment(spark, sf_dir):
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    found = op13_alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"), instead={"groups_sha256": digest})
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
