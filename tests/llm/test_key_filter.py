"""The key filter and the choice of representatives that uses it."""

import random

from pyspark.sql import functions as F

from quire.llm.common import shared_dir, split_by_keys
from quire.llm.simhash import chosen


def test_split_by_keys_loses_no_key_and_no_row(spark):
    rows = spark.range(5000).select("id", F.col("id").alias("part"), F.when(F.col("id") % 7 != 0, F.xxhash64("id")).alias("k"))
    for n in (0, 1, 700):
        keys = spark.range(n).select(F.xxhash64("id").alias("k"))
        maybe, rest = split_by_keys(rows, rows["k"], keys, shared_dir(spark), "bits")
        maybe, rest = {r.id for r in maybe.collect()}, {r.id for r in rest.collect()}
        assert not maybe & rest and maybe | rest == set(range(5000))
        assert {i for i in range(n) if i % 7} <= maybe
        assert len(maybe) <= n + 500


def test_chosen_matches_a_plain_loop(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(60)]), rnd.choice(["a", "b", "c", None]), i % 3, "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _id int, part string").repartition(4)
    found = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.ascii(F.coalesce("text", F.lit("-"))).cast("long").alias("root"))
    first = {}
    for d, t, *_ in rows:
        first[t] = min(first.get(t, (True, 0)), (d is None, d or 0))
    want = {(t, None if none else d) for t, (none, d) in first.items()}
    got = chosen(docs, found)
    assert got.columns == docs.columns
    assert sorted(((r.text, r.doc_id) for r in got.collect()), key=str) == sorted(want, key=str)
    assert chosen(docs.limit(0), found.limit(0)).count() == 0


def test_texts_of_kept_rows_are_not_moved(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.greatest("doc_id", F.lit(9)).alias("root"))
    got = chosen(docs, found)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
    assert sorted(r.doc_id for r in got.collect()) == [0, *range(10, 2000)]
