"""From documents to training sequences: toxicity, recurring lines, near duplicates, shared passages, packing.

Every stage takes (spark, docs, sf_dir) and returns documents, the last one the packed pieces; ``run`` writes each result to
the shared work folder and reads it again, so a stage starts from files and a lost executor costs no earlier stage.
Columns other than ``text`` and ``n_chars`` pass unchanged. Null texts pass every filter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import op2_jaccard, op5_packing, op7_passages, op9_lines, op10_toxicity
from tripweave.llm.common import keep, labels

REJECT_AT = 0.5


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below REJECT_AT; labels of the test fold aren't learned from."""
    model = op10_toxicity.fit(docs, labels(spark, sf_dir), whole=True)
    out = op10_toxicity.below(docs, model, REJECT_AT)           # scores are stored by now
    model.discard()
    return out


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of templates that recur across unrelated documents."""
    return _counted(op9_lines.drop_recurring_lines(docs, each_family_once=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five-word shingles, Jaccard 0.8)."""
    found = op2_jaccard.jaccard_components(docs, k=5, percent=80)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone_doc")).distinct() \
        .hint("merge")                                # the same plan at every size
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone_doc"], "left_anti")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 45 words or more that an earlier document has."""
    return _counted(op7_passages.drop_passages(docs, op7_passages.passages(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of a power of two tokens, each a sequence of its own."""
    packed = op5_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "ids")


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
          ("substring dedup", passage_dedup), ("packing", packing)]

#: SQL can't express the trained model, the alignment and the tokenizer; the stages are tested apart
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
