"""The pipeline: every stage keeps clean documents, catches planted ones and copes with odd inputs."""

import random

import corpus_pipeline
import pytest

from tests.llm.conftest import prose
from tests.llm.test_duplicates import edited


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels with toxic documents, shared lines, near copies and passages."""
    r, docs, labels = random.Random(31), [], []
    passage = prose(77, 70)
    for i in range(400):
        words = prose(5000 + i, r.randrange(60, 160)).split()
        toxic = i % 5 == 3
        if toxic:
            for _ in range(6):
                words.insert(r.randrange(len(words)), r.choice(["Blorgface", "zumpkin", "grotnik"]))
        text = " ".join(words)
        if i % 40 == 1:
            text += " " + passage
        if i % 8 == 2:
            text += "\nAll rights reserved by nobody 2021"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    near = edited(docs[0][1], r, 1)
    docs += [(1000, near, "en", "s", len(near)), (1001, docs[2][1], None, None, None), (1002, None, None, "s", None),
             (1003, "", "en", "s", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic, lines, near, passages = seen.values()
    assert sum(i % 5 == 3 for i in toxic if i < 400) <= 4 and sum(i % 5 != 3 for i in toxic if i < 400) == 320
    assert set(lines) == set(toxic) and not any("rights reserved" in (t or "") for t in lines.values())
    assert sum("rights reserved" in (t or "") for t in toxic.values()) > 20
    assert set(near) == set(lines) - {1000, 1001}
    holding = sorted(i for i, t in near.items() if prose(77, 70) in (t or ""))
    assert len(holding) > 3 and [i for i in holding if prose(77, 70) in passages[i]] == holding[:1]
    assert passages[1002] is None and passages[1003] == ""
    pieces = corpus_pipeline.packing(spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == set(passages)


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    want = sorted((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.packing(spark, docs, folder).collect())
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_stages_on_odd_and_empty_documents(spark, folder, edges, nothing):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edges, folder).columns == edges.columns
        assert stage(spark, edges, folder).where("doc_id in (1, 2)").count() == 2
        assert stage(spark, nothing, folder).count() == 0
    assert corpus_pipeline.packing(spark, nothing, folder).count() == 0
