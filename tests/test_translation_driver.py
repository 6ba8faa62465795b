"""The translation driver over several runs: what is asked again, what comes back, and what one bad chunk does to the others."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import Observation

from quire.operators import translation as T
from quire.sources import corpus as source

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests

DDL = "path string, lang string, text string"
LONG = "words that are long enough to be checked as prose"


def chapters(spark, *rows):
    return spark.createDataFrame(list(rows), DDL)


def shout(text, seed):
    return text.upper()


def by_place(state):
    return {(r.path, r.chunk_ix): r for r in state.collect()}


def test_blocks_and_tables_survive(spark):
    text = f"# a\n\n{LONG}\n\n```py\nkeep = 1\n```\n\n| one | 2 |\n|---|:-:|\n| x\\|y | `p|q` |\n\n@@HTML_START@@\n<b>keep</b>\n@@HTML_END@@\n\nend"
    docs = chapters(spark, ("a.md", "ko", text), ("none.md", "ko", None), ("empty.md", "ko", ""), ("blank.md", "ko", " \n\n "))
    state = T.translated(docs, shout, 60)
    made = {r.path: r.text for r in T.reassembled(docs, state).collect()}
    assert made == {"a.md": f"# A\n\n{LONG.upper()}\n\n```py\nkeep = 1\n```\n\n| ONE | 2 |\n|---|:-:|\n| X\\|Y | `P|Q` |\n\n@@HTML_START@@\n<b>keep</b>\n@@HTML_END@@\n\nEND", "none.md": "", "empty.md": "", "blank.md": " \n\n "}
    assert T.markers(state).isEmpty() and {r.kind for r in T.mirror(docs, state, "out/").collect()} == {"chapter"}


def stubborn(text, seed):
    return text if "stubborn" in text and seed < 5 else text.upper()


def test_a_resumed_run_asks_only_for_what_is_open(spark):
    text = f"{LONG} one\n\n{LONG} stubborn\n\n{LONG} three"
    docs = chapters(spark, ("a.md", "ko", text), ("b.md", "ko", f"{LONG} four"))
    first = T.translated(docs, stubborn, 60)
    got = by_place(first)
    assert (got["a.md", 1].attempts, got["a.md", 1].calls, got["a.md", 1].failed) == (3, 3, True) and not got["a.md", 0].failed
    mark = T.markers(first).first()
    assert (mark.path, mark.incomplete_chunks, mark.total_chunks, mark.chunk_chars) == ("a.md", [2], 3, 60)
    assert mark.chunks == [f"{LONG} one".upper(), f"{LONG} stubborn", f"{LONG} three".upper()]
    seen = Observation()
    second = T.translated(docs, stubborn, 60, first, progress=seen)
    assert seen.get == {"asked": 1, "failed": 0, "calls": 3}
    got = by_place(second)
    assert [k for k, r in got.items() if not r.reused] == [("a.md", 1)] and got["a.md", 1].attempts == 6
    assert T.reassembled(docs, second).filter("path = 'a.md'").first().text == text.upper()
    states = T.settled(docs, stubborn, 60, 5)
    assert len(states) == 2 and states[-1].filter("failed").isEmpty()


def test_changed_text_and_changed_limit(spark):
    text = f"{LONG} one\n\n{LONG} two\n\n{LONG} three"
    first = T.translated(chapters(spark, ("a.md", "ko", text)), shout, 60)
    edited = chapters(spark, ("a.md", "ko", text.replace("two", "2")))
    again = by_place(T.translated(edited, shout, 60, first))
    assert [r.reused for _, r in sorted(again.items())] == [True, False, True]
    assert not any(r.reused for r in T.translated(edited, shout, 61, first).collect())
    assert not any(r.reused for r in T.translated(edited, shout, 60).collect())


def raising(text, seed):
    if "bad" in text:
        raise ValueError("no such\nmodel")
    return text.upper()


def test_an_error_fails_its_chunk_alone(spark):
    docs = chapters(spark, ("a.md", "ko", f"{LONG} bad"), ("b.md", "ko", LONG))
    got = by_place(T.translated(docs, raising, 60))
    assert got["a.md", 0].failed and got["a.md", 0].error == "ValueError: no such\nmodel" and got["a.md", 0].result == f"{LONG} bad"
    assert not got["b.md", 0].failed and got["b.md", 0].error is None
    assert [r.path for r in T.markers(T.translated(docs, raising, 60)).collect()] == ["a.md"]


@pytest.mark.parametrize("lang,result,failed", [("en", "한국어 남음", True), ("en", "fine", False), ("ko", None, True), ("fr", None, False)])
def test_each_language_has_its_signal(spark, lang, result, failed):
    docs = chapters(spark, ("a.md", lang, LONG))
    assert T.translated(docs, lambda text, seed: result or text, 60).first().failed is failed


def test_configurations(spark):
    books = spark.createDataFrame([("a", "title: T\nlanguage: ko\nsplit:\n  files: [x.md]\n"), ("b", None), ("c", "")], "book string, config string")
    got = {r.book: r.config for r in source.configurations(books, "en").collect()}
    assert got == {"a": "title: T\nlanguage: en\nsplit:\n  files:\n  - x.md\n", "b": "language: en\n", "c": "language: en\n"}
