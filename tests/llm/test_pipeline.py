"""The pipeline: every stage on what the one before kept."""

import re
import sys

import corpus_pipeline
from test_jaccard import brute
from test_operators import DDL, ODD, corpus, documents

from quire.llm import mixing


def test_stages(spark, tmp_path):
    rows = corpus(120, 1) + [(5000 + d, t + " more", la, s) for d, t, la, s in corpus(120, 1) if len(t) > 600] + ODD
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "mix", "pack"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in first.collect()) == sorted(str(d) for d, t, _, _ in rows if t and re.search(r"[^\W\d_]", t))
    second = corpus_pipeline.near_duplicates(spark, first, str(tmp_path))
    kept = brute([(r.doc_id if r.doc_id is not None else 1 << 40, r.text) for r in first.collect()])
    assert sorted(1 << 40 if r.doc_id is None else r.doc_id for r in second.collect()) == kept
    third = corpus_pipeline.mix(spark, second, str(tmp_path))
    assert third.columns == [c.split()[0] for c in DDL.split(", ")]
    taken = mixing.mix(second).agg({"taken": "sum"}).first()[0]
    assert sum(len(r.text.split()) for r in third.select("text").collect()) == taken
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in third.collect()}


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert "corpus_pipeline" in sys.modules
