"""The divergence audit against SQL and plain loops, with odd rows: nulls, no terms, ties, repeats, other scripts, no rows."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quire.llm import divergence, registry

DDL = "doc_id long, text string, lang string, source string, term string, n int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, ranks=200):
    texts = [(la or "", so or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, la, so in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for la, so, terms in texts:
        df[la].update(set(terms))
        n[la, so].update(terms)
    out = []
    for la in {t[0] for t in texts}:
        kept = [t for t, d in df[la].items() if d >= least]
        groups = {so: n[la, so] for x, so, _ in texts if x == la}
        p = {so: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept} for so, c in groups.items()}
        whole = sum((n[la, so] for so in groups), Counter())
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole[k] for k in kept) + len(kept)) for t in kept}
        for so in groups:
            pairs = [(-sum((p[so][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in groups if o != so]
            out += [(la, so, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(sorted(pairs), 1)]
            terms = [(-((p[so][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[so][t] and p[so][t] > q[t]]
            out += [(la, so, "term", t.decode(), -v, i) for i, (v, t) in enumerate(sorted(terms)[:ranks], 1)]
    return sorted(out)


def sample(seed, n=160):
    rnd = random.Random(seed)
    vocabulary = ["The", "the", "été", "É", "naïve", "x", "İ", "straße", "日本", "a1b", "o'clock", "🙂", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 40))), rnd.choice(["en", "en", "de", None, ""]), rnd.choice([None, "", "s1", "s1", "é", "z"])) for i in range(n)]
    rows += [(900, None, "fr", "only"), (901, "12 34", "fr", "other"), (902, "one two", "xx", "s"), *[(903, "same same row", "en", "s1")] * 4, (None, "the " * 5000, "en", "long"), (904, "\x7f\x80\x00the\x00", "de", "z")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_plain_loops(spark, monkeypatch, seed):
    rows = sample(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL)
    if seed == 2:  # several blocks, buckets and tiles
        monkeypatch.setattr(divergence, "BUCKET_POSTINGS", 40)
        monkeypatch.setattr(divergence, "TILE", 2)
    got = divergence.audit(df.repartition(4), term_ranks=7 if seed == 2 else 200)
    assert sorted(map(tuple, got.collect())) == plain(rows, ranks=7 if seed == 2 else 200)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], DDL)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = registry.queries()["op13_divergence"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(divergence.oracle()).fetchall())


def test_shares_do_not_overflow(spark):
    n, total = 8 * 10**14, 9 * 10**14 + 7
    want = 1 + 10**9 * n // total
    assert divergence.shares(np.array([n]), total)[0] == want
    from pyspark.sql import functions as F

    assert spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long"))).first()[0] == want


def test_padded_terms_are_found_whole():
    text = divergence.folded("Été,the THE a-b".encode())
    assert text == " Été the the a b ".encode()
    names = ["the", "b", "he"]
    assert divergence.occurrences_in(divergence.automaton_of(names), text.decode(), 3).tolist() == [2, 1, 0]
