"""The pipeline operators against brute force, with odd rows: nulls, empty and long texts, ties, repeats, empty tables."""

import base64
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from quire.llm import impact, langid, licenses, mih, mixing, packing, tokens, urls, warc
from quire.llm.common import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
DDL = "doc_id long, text string, lang string, source string, n_chars long, size string, score int"


def documents(spark, rows):
    """(doc_id, text, lang, source) with columns whose names clash with results."""
    return spark.createDataFrame([(d, t, la, s, None if t is None else len(t), "x", 7) for d, t, la, s in rows], DDL)


WORDS = {
    "en": "the of and to in that is was he for it with as his on be at by this had not are but from or have an they which one".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se le ce il sont la les avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque".split(),
}


def corpus(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(WORDS))
        rows.append((i, " ".join(rnd.choices(WORDS[lang], k=rnd.randint(8, 300))), lang, f"s{i % 3 if i % 2 else 0}"))
    return rows


ODD = [(9001, None, "en", "s1"), (9002, "", "en", None), (None, "the of and", None, "s2"), (9003, "1234 !!!", "de", "s1"), (9004, " \n\t\x0b ", None, "s1"),
       (9005, "the of " * 40000, "en", "s0"), (9006, "same text here", "en", "s0"), (9006, "same text here", "en", "s0"), (9007, "x <|endoftext|> y's", "en", "é")]


def test_tokens_and_bytes(spark):
    rows = corpus(40) + ODD
    library = tokens.Splitter(tokens.specification(PATH)).library
    got = tokens.token_counts(documents(spark, rows), PATH).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, _, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert tokens.token_counts(documents(spark, []), PATH).count() == 0


def test_chunk_maps_compose_to_the_same_count():
    machine = tokens.CountingTransducer(tokens.specification(PATH))
    rnd = random.Random(4)
    parts = [*"aB1 '\n\t\x1c\x85 é漢😀-_.!²٣　", "<|endoftext|>", "  ", "'ll", "the", "\U0001e4d0"]
    for _ in range(2000):
        s = "".join(rnd.choices(parts, k=rnd.randint(0, 30)))
        want = len(machine.library.encode(s, add_special_tokens=False).ids)
        assert machine.count(s) == want == machine.count(s, chunk=rnd.randint(1, 9)), s


def test_every_token_is_its_own_encoding():
    machine = tokens.CountingTransducer(tokens.specification(PATH))
    assert all(sum(machine.emissions(v)) == 1 for v in list(machine.number)[::37])


def test_packing_holds_every_id_once_without_padding(spark):
    rows = corpus(200, 3) + ODD
    library = tokens.Splitter(tokens.specification(PATH)).library
    ids = {}
    for d, t, _, _ in rows:
        ids.setdefault(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    got = packing.packed(documents(spark, rows).repartition(3), PATH).collect()
    times = {d: sum(r[0] == d for r in rows) for d in ids}
    covered = {d: 0 for d in ids}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        covered[r.doc_id] += r.length
    assert covered == {d: len(x) * times[d] for d, x in ids.items()}
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    fills = []
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        fills.append(at)
    assert max(fills) <= 2048 and all(f & (f - 1) == 0 for f in fills)
    assert packing.packed(documents(spark, []), PATH).count() == 0


def test_sum_of_squares_rule():
    """Each rest goes where the sum of squared level counts grows least, as a plain loop finds it."""
    rnd = random.Random(2)
    p, counts = packing.Packer(16), [0] * 17
    for i in range(400):
        size = rnd.randint(1, 15)
        options = [((counts[size] + 1) ** 2 - counts[size] ** 2, 0)]
        for h in range(1, 17 - size):
            if counts[h]:
                after = list(counts)
                after[h] -= 1
                after[h + size] += h + size < 16
                options.append((sum(x * x for x in after) - sum(x * x for x in counts), -h))
        level = -min(options)[1] if min(options)[0] < options[0][0] else 0
        counts[level] -= level > 0
        counts[level + size] += level + size < 16
        list(p.add((i, size), b"\1\0\0\0" * size))
        assert p.levels.tolist()[1:16] == counts[1:16]


def test_languages(spark):
    rows = corpus(400, 5) + ODD
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify(documents(spark, rows)).collect()}
    assert sum((d, la) in got for d, _, la, _ in rows[:400]) >= 396
    for r in got.values():
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {d for d, la in got if la == "und"} == {9001, 9002, 9003, 9004}
    assert langid.identify(documents(spark, [])).count() == 0
    one = [(i, "the of and", "en", "s") for i in range(20)]
    assert {r.lang_pred for r in langid.identify(documents(spark, one)).collect()} == {"en"}
    kept = langid.kept(documents(spark, rows))
    assert kept.columns == [c.split()[0] for c in DDL.split(", ")] and kept.count() == len(rows) - 4


def test_nothing_is_learned_from_held_out_rows(spark):
    rows = [(i, "the of and" if zlib.crc32(str(i).encode()) % 4 != 2 else "xx yy", "en" if zlib.crc32(str(i).encode()) % 4 != 2 else "zz", "s") for i in range(60)]
    assert {r.lang_pred for r in langid.identify(documents(spark, rows)).collect()} == {"en"}


def level(sizes, names):
    """Targets by handing on the excess until none is above."""
    order = sorted(names, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mixing_meets_its_targets(spark):
    rows = corpus(600, 6) + ODD
    got = mixing.mix(documents(spark, rows), shard_rows=50)
    found = got.select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want = level(sizes, set(sizes))
    for s in sizes:
        mine = [r for r in found if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(math.isclose(r.target, want[s], rel_tol=1e-9) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 0.01 * want[s] + 2
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    again = mixing.mix(documents(spark, rows[::-1]).repartition(5), shard_rows=50).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mix(documents(spark, [])).count() == 0
    out = mixing.mixed_documents(documents(spark, rows), shard_rows=50)
    assert out.columns == [c.split()[0] for c in DDL.split(", ")]
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall("[^\x20\x09-\x0d]+", r.text))
        assert r.n_chars == len(r.text)
    taken = {}
    for r in found:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert words == {d: n for d, n in taken.items() if n}


CASES = [([5, 3, 1], 7, 9), ([1, 1, 1, 1], 2, 9), ([53, 24, 23], 10, 9), ([10, 10, 1], 9, 4), ([0.0, 4], 3, 9), ([97.6] + [0.12] * 20, 100, 1000),
         ([1000] + [4] * 60, 100, 1000), ([100, 100, 1, 1, 1, 1], 60, 20), ([3, 2], 30, 4), ([7.5], 0, 3), ([1e12, 1, 1], 50, 48)]


def test_apportionment_is_sainte_lague(spark):
    """Against the plain loop over highest quotients: giants, many small parties, ceilings, ties, random votes; all groups at once."""
    rnd = random.Random(3)
    cases = CASES + [([rnd.choice([1, 10, 1000]) * rnd.random() for _ in range(rnd.randint(1, 60))], rnd.randint(0, 400), rnd.choice([3, 20, 1000])) for _ in range(40)]
    rows = [(g, i, float(v), most, seats) for g, (votes, seats, most) in enumerate(cases) for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, i int, v double, most long, total long")
    got = {(r.g, r.i): r.n for r in mixing.apportion(df, "v", "most", "total", ["g"], ["i"], "n").collect()}
    for g, (votes, seats, most) in enumerate(cases):
        want = [0] * len(votes)
        for _ in range(seats):
            i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1) if want[i] < most and votes[i] > 0 else -1, -i))
            if votes[i] > 0 and want[i] < most:
                want[i] += 1
        assert [got[g, i] for i in range(len(votes))] == want, cases[g]
    one = mixing.apportion(df.filter("g = 5").drop("g"), "v", "most", "total", [], ["i"], "n").collect()
    assert sorted((r.i, r.n) for r in one if r.n) == [(0, 100)]


def test_mix_keeps_documents_whole(spark):
    """One document a shard is cut, also beside a source of five words; the others come whole, at most rounds + 1 times."""
    rows = corpus(300, 9) + [(7000, "a b c d e", "en", "tiny"), (7001, "", "en", "none"), (7001, "", "en", "none")]
    plan = mixing.mix(documents(spark, rows), shard_rows=40).collect()
    cut = [r for r in plan if 0 < r.part < r.size]
    assert all(r.taken == r.whole * r.size + r.part and 0 <= r.part <= r.size for r in plan)
    shards = {s: -(-sum(r[3] == s for r in rows) // 40) for s in {r[3] for r in rows}}
    assert all(sum(r.source == s for r in cut) <= n for s, n in shards.items())
    assert next(r for r in plan if r.source == "tiny").taken == 10
    out = mixing.mixed_documents(documents(spark, rows), shard_rows=40).collect()
    assert len(out) <= len(rows) * 2 + sum(shards.values())
    texts = {(d, t) for d, t, _, _ in rows}
    assert sum((r.doc_id, r.text) not in texts for r in out) <= len(cut)


def test_first_words(spark):
    from pyspark.sql import functions as F

    text = " a\tb\n\x0bc  d " + "w " * 50000
    df = spark.createDataFrame([(text, n) for n in (1, 3, 4, 40000)], "t string, n long")
    got = {r.n: r.x for r in df.select("n", mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()}
    assert got[1] == "a" and got[3] == "a\tb\n\x0bc" and got[4] == "a\tb\n\x0bc  d" and len(got[40000].split()) == 40000


VECTORS = "vec_id long, embedding array<float>, label int, score string"


def vectors(n=400, dims=16, extra=()):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=dims) / 4).astype(np.float32).tolist(), 1, "x") for i in range(n)]
    rows += [(1000 + i, rows[7][1], 1, "x") for i in range(120)]  # equal vectors: ties
    return rows + [(i, v, None, None) for i, v in extra]


EXTRA = [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 16), (2060, [float("inf")] * 16), (2080, []), (2100, [0.0] * 16), (2120, [0.5] * 4), (None, [0.1] * 16), (2120, [0.5] * 4)]


def best(rows, k, step, score):
    valid = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    dims = max(map(len, valid.values()))
    x = {i: np.pad(v, (0, dims - len(v))) for i, v in valid.items()}
    out = {}
    for q in x:
        if q % step == 0:
            s = sorted((-score(x[q], x[c]), c) for c in x if c != q)
            out[q] = [(i + 1, c, -v) for i, (v, c) in enumerate(s[:k])]
    return out


def test_impact_search_is_exact(spark):
    rows = vectors(extra=EXTRA)
    got = {}
    for r in impact.top_k(spark.createDataFrame(rows, VECTORS), query_step=20, candidate_block=64, query_block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = best(rows, 5, 20, lambda a, b: int((np.floor(256 * a) * np.floor(256 * b)).sum()))
    assert {q: sorted(v) for q, v in got.items()} == want
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert impact.top_k(few).count() == 2
    assert impact.top_k(spark.createDataFrame([], VECTORS)).count() == 0


def test_impact_search_with_large_components():
    """Scores in whole numbers, cut to the range of a long; several rows of one id take one place."""
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(size=(60, 4)) * 10.0 ** rng.integers(0, 12, size=(60, 1)))
    v[7] = 1e37
    ids = np.arange(60)
    ids[50:] = 3
    frame = pd.DataFrame({"id": ids, "payload": [x.astype("<f8").tobytes() for x in v], "wide": True})
    got = impact.block_best(None, frame, frame[:9], 5)
    for i in range(9):
        if i == 3:
            continue
        best = {}
        for j, other in zip(ids, v):
            if j != i:
                score = min(max(sum(int(x) * int(y) for x, y in zip(v[i], other)), -(1 << 63)), (1 << 63) - 1)
                best[j] = max(score, best.get(j, score))
        want = sorted((-s, j) for j, s in best.items())[:5]
        assert [(-r.score, r.vec_id) for r in got[got.query_id == i].itertuples()] == want


def test_impact_index_stops_early_where_impacts_differ():
    """Sparse vectors: few postings are read, and the best are whole."""
    rng = np.random.default_rng(4)
    v = np.where(rng.random((800, 64)) < 0.1, np.floor(256 * rng.pareto(1.5, (800, 64))), 0.0)
    index = impact.ImpactIndex(v)
    assert sum(len(s[3]) for s in index.segments) == np.count_nonzero(v)
    q, c, s = index.search(v[:40], np.eye(40, 800, dtype=bool), 5)
    full = v[:40] @ v.T
    full[np.arange(40), np.arange(40)] = -np.inf
    for i in range(40):
        assert sorted(s[q == i])[-5:] == sorted(full[i])[-5:]
    assert len(q) < 40 * 800 / 2


def test_multi_index_finds_every_code_in_reach():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, size=(500, 2), dtype=np.uint64)
    codes[100:] = codes[:400] ^ (np.uint64(1) << rng.integers(0, 63, size=(400, 2)).astype(np.uint64))
    for radius in (0, 2, 9, 60):
        q, c = mih.MultiIndex(codes).within(codes[:50], radius)
        want = np.bitwise_count(codes[:50, None] ^ codes[None]).sum(-1) <= radius
        got = np.zeros_like(want)
        got[q, c] = True
        assert (got == want).all()


def test_nearest_neighbours_reach_the_recall(spark):
    rows = vectors(extra=EXTRA)
    got = {}
    for r in mih.nearest(spark.createDataFrame(rows, VECTORS), candidate_block=64, query_block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = best([r for r in rows if r[1] and None not in r[1] and np.any(r[1])], 20, 20, lambda a, b: float((a * b).sum()))
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert [(-s, c) for _, c, s in sorted(found)] == sorted((-s, c) for _, c, s in found)
        floor = want[q][-1][2] - 1e-9
        hits += sum(s >= floor for _, _, s in found)
    assert hits >= 0.9 * 20 * len(got)
    assert mih.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    assert mih.nearest(spark.createDataFrame(rows[:3], VECTORS)).count() == 2


PAGES = "page_id long, url string, html string, digest string, bound string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


PAGE_ROWS = [(1, "http://A.com/x?y", "<p>é</p>"), (2, "https://www.a.com:80/", None), (3, None, ""), (4, "nothing", "<p>é</p>"), (5, "http://b.org/\n x", "z" * 300000), (6, "://h#f", "<p>é</p>"),
             (None, "http://n/", "q"), (7, "http://t.co.uk/a\r\nWARC-Type: x", "q"), (7, "http://t.co.uk/a", "q"), (8, "http://é.com/ü%20", "\r\n\r\n"), (None, None, "solo")]


def test_archives_round_trip(spark):
    got = sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in warc.round_trip(pages(spark, PAGE_ROWS)).collect())
    largest = {}
    for i, _, h in PAGE_ROWS:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGE_ROWS:
        b = (h or "").encode()
        keeper = largest[h or ""]
        revisit = keeper >= 0 and i != keeper
        want.append(str((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None)))
    assert got == sorted(want)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_lookup_by_url(spark):
    many = [(i, f"http://h{i % 7}.example.com/p/{i % 400}", f"body {i}") for i in range(1500)]
    directory = warc.write_archives(pages(spark, many + PAGE_ROWS), shared_dir(spark))
    asked = ["http://h3.example.com/p/10", "http://A.com/x?y", "http://absent.example.com/", "nothing"]
    got = sorted((r["url"], r["page_id"]) for r in warc.lookup(directory, asked))
    assert got == sorted((u, i) for i, u, _ in many + PAGE_ROWS if u in asked)
    assert next(r for r in warc.lookup(directory, [asked[0]]) if r["record_type"] == "response")["payload"].startswith(b"body")


def same(spark_rows, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted(str(tuple(r[n] for n in names)) for r in spark_rows) == sorted(map(str, cur.fetchall()))


def arrow(df):
    """Rows of a small frame as an Arrow table with nulls as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    return pa.Table.from_pylist([r.asDict() for r in df.collect()], schema=schema)


def test_url_rules_and_reputation(spark):
    rnd = random.Random(9)
    urls_ = ["http://www.example.com/en/7x", "https://example.com/en/1", "HTTP://X.EXAMPLE.NET/de/8/1", "http://net/de/8", "http://a.org/es/", "http://a.org?/es/", "x", None, "http://notexample.com/en/7", "http://com/en/#x", "ftp://u:p@Ünï.ORG:21/es/x?y", "://"]
    rows = [(i, u, "h") for i, u in enumerate(urls_)] + [(100 + i, f"http://h{rnd.randint(0, 9)}.d{rnd.randint(0, 3)}.{rnd.choice(['xyz', 'co.uk', 'info'])}/{i}", "h") for i in range(600)] + [(None, "http://h1.d1.xyz/", None), (3, "http://net/de/8", "h")]
    bad = [(i, 1, 1 if (u or "").startswith("http://h1.d1") or rnd.random() < 0.1 else 0) for i, u, _ in rows if i is not None] + [(5, None, None), (8, 1, None), (101, 0, 0)]
    labels = spark.createDataFrame(bad, "doc_id long, quality int, toxic int")
    df = pages(spark, rows)
    got = urls.judge(df, labels).collect()
    assert len(got) == len(rows)
    assert same(got, urls.oracle(), pages=arrow(df), labels=arrow(labels))
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got if r.page_id is not None}
    assert by[0] == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert by[1] == ("example.com", "/en/1", "com/en/", "block")
    assert by[2] == ("x.example.net", "/de/8/1", "example.net/de/8", "block")
    assert by[3] == ("net", "/de/8", "net/de/", "allow")
    assert by[6][:3] == ("", "", None)
    assert by[8][2] == "com/en/"
    assert any(r.rule is None and r.verdict == "block" for r in got)
    assert urls.judge(pages(spark, []), labels).count() == 0
    assert {r.verdict for r in urls.judge(df, labels.limit(0)).filter("rule is null").collect()} == {"allow"}


def test_licences(spark):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    rows = corpus(30) + ODD + [(100 + i, f"a line\n{x}\nanother", "en", "s") for i, x in enumerate(lines)]
    rows += [(200 + i, x, "en", "s") for i, x in enumerate(licenses.OTHERS)] + [(300, "\n".join(lines), "en", "s"), (301, "licensed " * 5000, "en", "s"), (302, "warrant", "en", "s")]
    df = documents(spark, rows)
    got = licenses.scan(df).collect()
    assert same(got, licenses.oracle(), documents=arrow(df.select("doc_id", "text")))
    by = {r.doc_id: r for r in got}
    assert [by[100 + i].families for i in range(len(lines))] == list(lines.values())
    assert not any(by[200 + i].confirmed for i in range(len(licenses.OTHERS)))
    assert by[300].confirmed == 4 and by[9001].candidates == 0
    assert licenses.scan(documents(spark, [])).count() == 0
    model = licenses.default_model()
    assert model.right > 0.6 and model.calibration_error < 0.25


def test_exact_search_and_archives_against_sql(spark):
    df = spark.createDataFrame(vectors(extra=EXTRA), VECTORS)
    assert same(impact.top_k(df).collect(), impact.oracle(), embeddings=arrow(df.select("vec_id", "embedding").filter("size(embedding) in (16, -1)")))
    rows = [r for r in PAGE_ROWS if r[0] is not None]
    assert same(warc.round_trip(pages(spark, rows)).collect(), warc.oracle(), pages=arrow(pages(spark, rows)))
