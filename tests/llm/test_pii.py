"""Personal data against SQL and plain loops, with odd rows: nulls, empty and very long texts, ties, repeats, no rows, clashing columns."""

import hashlib
import random
import re
import time
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from quire.llm import pii, registry

DDL = "doc_id long, text string, base string, terms string, k1 int, lang string"


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_of(text):
    out = []
    for rank, (kind, pattern) in enumerate(pii.PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), f"{kind}:{m[0].lower() if kind == 'email' else m[0] if kind == 'ip' else digits}"))
    return sorted(out)


def around(text, kind, start, end):
    """CONTEXT characters on both sides up to the next match of the kind, without cut words."""
    cuts = [(m.start(), m.end()) for m in re.finditer(pii.PATTERNS[kind], text)]
    before = text[max([e for _, e in cuts if e <= start], default=0) : start]
    after = text[end : min([s for s, _ in cuts if s >= end], default=len(text))]
    letters = pii.WORD.replace("{3,}", "+")
    left = re.sub(r"\A" + letters, "", before[-pii.CONTEXT :]) if len(before) > pii.CONTEXT else before
    right = re.sub(letters + r"\Z", "", after[: pii.CONTEXT]) if len(after) > pii.CONTEXT else after
    return f"{left} {right}"


def plain(rows):
    texts = {t or "" for _, t in rows}
    contexts, together, with_entity, having = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        for w in re.findall(pii.WORD, t):
            having[w].add(t)
        for start, rank, end, entity in base_of(t):
            near = around(t, pii.KINDS[rank], start, end)
            for w in re.findall(pii.WORD, near):
                contexts[entity, w].add(near)
                together[entity, w].add(t)
                with_entity[entity].add(t)
    flagged = set()
    for (e, w), c in contexts.items():
        weight = len(c) + len(having[w]) - len(together[e, w]) + 1
        if len(c) >= 3 and len(c) / weight >= 0.75 and len(c) * len(texts) >= 16 * len(with_entity[e]) * weight:
            flagged.add(w)
    out = []
    for d, t in rows:
        base = base_of(t or "")
        terms = [(m.start(), 4, m.end()) for m in re.finditer(pii.WORD, t or "") if m[0] in flagged]
        terms = [x for x in terms if not any(b[0] < x[2] and x[0] < b[2] for b in base)]
        name = lambda s: f"{(*pii.KINDS, 'term')[s[1]]}:{s[0]}:{s[2]}"
        out.append((d, *(sum(b[1] == k for b in base) for k in range(4)), hashlib.sha256(",".join(map(name, base)).encode()).hexdigest(), ",".join(map(name, sorted([*base, *terms])))))
    return sorted(out, key=str), flagged


ODD = [(None, None), (1, ""), (2, "a@b.c_d@e.f.g x@y a@@b.c .@-.-"), (2, "a@b.c_d@e.f.g x@y a@@b.c .@-.-"), (3, "1.2.3.4.5.6.7.8 001.002.255.0000 256.1.1.1 1.2.3"), (4, "4111 1111-1111 1111 4111111111111112 0000000000000000000 12345"),
       (5, "+1 (499) 555-6503 +49 30 1234567890123 +4 +49.(30)-12345678) é🙂 +4912345678901"), (6, "日本🙂 mail: é.x@mail.example.com, 🙂10.0.0.1"), (7, "+1 4111 1111 1111 1111 a.b@c.d"), (8, "x" * 300), (9, "..@.. @a.b %@1.2")]


def related():
    """Ada Quill and her address in many contexts; common words beside it; a group of near copies with another address."""
    rnd = random.Random(7)
    common = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    say = lambda n: " ".join(rnd.choices(common, k=n))
    rows = [(100 + i, say(30)) for i in range(200)]
    rows += [(400 + i, f"{say(12)} Quillington {say(2)} ada@quill.example.org {say(12)}") for i in range(12)]
    rows += [(450, f"{say(9)} Quillington {say(9)}")]
    copy = f"{say(10)} Zanzibar rare@copy.example.org uncommon {say(10)}"
    rows += [(500 + i, f"{copy} {say(3)}") for i in range(9)]
    rows += [(600 + i, f"{say(3)} Onlythrice {say(1)} +49 30 12345678 {say(4)}") for i in range(3)]
    return rows


def test_scan_equals_plain_loops(spark):
    rows = ODD + related()
    want, flagged = plain(rows)
    assert {"Quillington", "Onlythrice"} <= flagged and not {"Zanzibar", "uncommon"} & flagged
    df = spark.createDataFrame([(d, t, "x", "y", 3, "en") for d, t in rows], DDL)
    scanned = pii.scan(df.repartition(4))
    assert sorted(map(tuple, pii.digests(scanned).collect()), key=str) == want
    clean = {r.doc_id: r.clean for r in pii.sanitised(scanned.filter("doc_id in (2, 6, 7, 450, 600) or doc_id is null")).collect()}
    assert clean[6] == "日本🙂 mail: é[email], 🙂[ip]" and clean[None] == ""
    assert "Quillington" not in clean[450] and "[name]" in clean[600] and "[phone]" in clean[600]


def test_many_candidate_terms_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(pii, "SENT_TERMS", 0)
    rows = ODD + related()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, pii.digests(pii.scan(df)).collect()), key=str) == plain(rows)[0]


def test_no_rows(spark):
    assert pii.scan(spark.createDataFrame([], DDL)).count() == 0


def test_query_equals_sql_and_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, registry.queries()["op12_pii"](spark, sf).collect()), key=str)
    assert got == sorted(con.execute(pii.oracle()).fetchall(), key=str)
    assert got == plain(con.execute("SELECT doc_id, text FROM documents").fetchall())[0]


def test_sql_of_related_terms(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ODD + related())
    assert sorted(con.execute(pii.oracle()).fetchall(), key=str) == plain(ODD + related())[0]


def test_random_texts_have_the_spans_of_plain_patterns(spark):
    rnd = random.Random(11)
    parts = ["a", "@", ".", "b.c", "1", "12", "4111111111111111", " ", "-", "+", "+49 ", "(", ")", "255", "1.1.1.1", "é", "🙂", "\n", "_", "x@y.zz", "%"]
    rows = [(i, "".join(rnd.choices(parts, k=rnd.randint(1, 40)))) for i in range(1500)]
    got = pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "base").collect()
    assert {r.doc_id: [tuple(s) for s in r.base] for r in got} == {d: [s[:3] for s in base_of(t)] for d, t in rows}


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 400000 + "@", "1" * 400000, "a." * 200000 + "@a" + ".a" * 100000, "1.2.3." * 60000, "1 " * 200000, "+1" * 100000, "x@y.zz " * 30000, "z" * 300000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    n = {r.doc_id: r.n for r in pii.with_spans(df).select("doc_id", F.size("base").alias("n")).collect()}
    assert n == {0: 0, 1: 0, 2: 1, 3: 45000, 4: 0, 5: 0, 6: 30000, 7: 0}
    assert time.time() - began < 60
