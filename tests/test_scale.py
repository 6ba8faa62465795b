"""What a query holds or moves must not follow the size of its tables."""

import pandas as pd
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions import text as X
from quire.operators import corpus as C
from quire.plans import registry

SF = "/root/testdata/sf0.001"


def test_batches_of_python_functions_are_bounded(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    registry.queries()["x1_slug"](spark, SF)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def test_nodes_come_back_in_bounded_frames():
    pages = pd.DataFrame({"key": range(100), "html": ["<p>a</p>" * 500] * 100})
    frames = list(M.node_frames(iter([pages])))
    assert sum(map(len, frames)) == 100 * 1000 and max(map(len, frames)) <= M.FRAME_NODES
    assert list(M.node_frames(iter([pages[:0]])))[0].empty


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_are_dealt_once(spark):
    assert _exchanges(registry.queries()["w7_row_groups"](spark, SF)) == 1
    assert _exchanges(registry.queries()["w10_table_runs"](spark, SF)) == 2


def test_word_count_by_splits(spark):
    rows = [("",), (None,), ("  ",), ("a",), (" a　b\x85 c\n",)]
    got = spark.createDataFrame(rows, "s string").select(X.word_count(F.col("s")).alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 0, 1, 3]


def test_needles_of_all_kinds_are_found_without_keys_at_every_character(spark, monkeypatch):
    bodies = [(1, "x" * 50 + " tail"), (2, "one two three four five six seven eight nine ten"), (3, "ab " + "y" * 60), (4, " " * 45 + "z"), (5, "A one two three four five six seven eight nine ten"), (6, "longlonglonglonglonglong word and then some others too")]
    needles = [(i, code) for i, code in enumerate(b[at : at + 50] for _, b in bodies for at in (0, 3, 7, 45)) if code]
    kept, held = [], C._held
    monkeypatch.setattr(C, "_held", lambda n, g, t: (kept.append(g.count()), held(n, g, t))[1])
    got = C.first_contained(spark.createDataFrame(needles, "needle_id long, code string"), spark.createDataFrame(bodies, "text_id long, body string")).collect()
    assert {r.needle_id: r.text_id for r in got} == {i: min(t for t, b in bodies if code[:40] in b) for i, code in needles}
    assert kept[0] <= sum(len(b.split()) + 1 for _, b in bodies)


def test_words_of_the_import_stay_where_their_page_is(spark):
    from quire.operators import page_import as P
    from quire.plans.views import v_words
    from quire.session import co_located, written_dealt

    with co_located(spark):
        words = written_dealt(v_words(spark, SF).select(*P.WORD), ["doc_id", "page"], 4)
        assert _exchanges(P.in_rows(words)) == 0
        assert _exchanges(P.in_regions(words.withColumn("row", F.floor("top").cast("int")))) == 0
    assert words.count() == v_words(spark, SF).count()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_cuts_look_at_gaps_from_the_target_down_alone():
    import random

    from quire.operators import splitting as S

    rnd = random.Random(5)
    for _ in range(3000):
        bands = [(a, a + rnd.choice([0, 1, 7.5, 40])) for a in (rnd.choice([rnd.randint(0, 300), rnd.random() * 300]) for _ in range(rnd.randint(0, 12)))]
        end, room = rnd.choice([rnd.randint(1, 320), rnd.random() * 300]), rnd.choice([5, 60, 200])
        gaps = S.free_gaps(bands)
        upto = sum(a <= end for a in gaps[:, 0])
        assert S.last_free(end, gaps.tolist(), upto, end - 0.6 * room) == S.nearest_free(end, gaps, end - 0.6 * room, end)
    seen = []

    class Gaps(list):
        def __getitem__(self, i):
            seen.append(i)
            return super().__getitem__(i)

    assert S.last_free(5.0, Gaps([[float(i), i + 0.5] for i in range(1000)]), 6, 2.0) == 5.0 and seen == [5]


def test_a_run_writes_its_state_once(spark, monkeypatch):
    from quire.operators import translation as T

    kept, write = [], T.written
    monkeypatch.setattr(T, "written", lambda df: (kept.append(df), write(df))[1])
    chapters = spark.createDataFrame([("a", "ko", "one two\n\n" * 60), ("b", "ko", "x")], "path string, lang string, text string")
    first = T.translated(chapters, lambda t, seed: "T" + t, 100)
    again = T.translated(chapters, lambda t, seed: "U" + t, 100, first)
    assert len(kept) == 2 and "Join" not in kept[0]._jdf.queryExecution().executedPlan().toString()
    assert [r.result[0] for r in again.collect()] == ["T"] * first.count() and again.filter("reused and calls = 0").count() == first.count()


def test_equal_needles_are_looked_up_once_and_short_ones_found(spark, monkeypatch):
    asked, held = [], C._held
    monkeypatch.setattr(C, "_held", lambda n, g, t: (asked.append(n.count()), held(n, g, t))[1])
    texts = [(1, "xx abcdefghij klmnopqrs yy"), (2, "one two three four five six seven eight nine ten"), (3, "the same: one two three four five six seven eight nine")]
    needles = [(i, "one two three four five six seven eight") for i in range(5)] + [(5, "abcdefghij klmnopqrs")]
    got = C.first_contained(spark.createDataFrame(needles, "needle_id long, code string"), spark.createDataFrame(texts, "text_id long, body string")).collect()
    assert {r.needle_id: r.text_id for r in got} == {**{i: 2 for i in range(5)}, 5: 1}
    assert sum(asked) == 2


def test_a_further_run_writes_failed_chunks_alone(spark, monkeypatch):
    from quire.operators import translation as T

    def slow(text, seed):
        return text if "slow" in text and seed < 4 else "T" + text

    kept, write = [], T.written
    monkeypatch.setattr(T, "written", lambda df: (kept.append(write(df)), kept[-1])[1])
    chapters = spark.createDataFrame([("a", "ko", "some words of a paragraph\n\n" * 9 + "a slow one of many letters"), ("b", "ko", " "), ("c", "ko", None)], "path string, lang string, text string")
    states = T.settled(chapters, slow, 40, 5)
    assert [k.count() for k in kept] == [11, 1] and [s.filter("failed").count() for s in states] == [1, 0]
    rows = lambda s: sorted(s.collect(), key=lambda r: (r.path, r.chunk_ix))
    # as a resumed run over the chapters makes it
    assert rows(states[1]) == rows(T.translated(chapters, slow, 40, states[0])) and states[1].columns == states[0].columns


def test_words_meet_their_rows_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # of texts, on either side of the join
        assert _exchanges(registry.queries()["w6_anchored_rows"](spark, SF)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_import_moves_words_once(spark):
    from quire.operators import page_import as P
    from quire.plans.views import v_words

    words = P.gathered(v_words(spark, SF).select(*P.WORD))
    assert _exchanges(words) == 1
    assert _exchanges(P.region_texts(words)) == 1
    pages = spark.createDataFrame([(1, 0, 1000.0)], "doc_id long, page int, height double")
    # pages twice (to be joined, to be looked for), words on either side once
    assert _exchanges(P.page_texts(pages, words, headings=False)) <= 5
