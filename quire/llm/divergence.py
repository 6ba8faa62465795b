"""Source divergence audit: how far the vocabularies of a language's sources lie apart.

Two passes over the texts. The first counts, exactly, in how many documents each term occurs. The second builds automata of
the kept terms, each padded with delimiters, and recounts occurrences in the delimiter-padded texts: a pad at both ends makes
every hit a whole term, and neighbouring hits share theirs.

No task holds a whole vocabulary. Texts are cut into blocks of bounded size; a block's postings (its own terms with their
document counts) come back to it as those that were kept, and its automaton has these terms alone.

Divergences are floors of quotients, so sums must be over terms. Postings are sparse: a term that neither source has adds the
same amount as any other such term, one that a single source has depends on that source's count alone, and only terms that two
sources share are visited as pairs, shift by shift over a term's postings, in blocks of terms and tiles of sources.
"""

from __future__ import annotations

from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, shared_dir, written

MIN_DOCUMENTS = 3
TERM_RANKS = 200
#: Bytes of text in a block: its automaton has at most half as many terms.
BLOCK_BYTES = 8 << 20
#: Postings (term, source) that one task takes, about, and sources of a tile.
BUCKET_POSTINGS, TILE = 1 << 18, 1024
#: A task's answers to the ranks of terms are taken in so many parts of each group first.
RANK_PARTS = 32
SCALE = 10**9

#: Bytes of terms: letters, small ones for A-Z, and whatever isn't ASCII; all others become delimiters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BLOCK = ["lang", "source", "salt"]
POSTINGS = "lang string, source string, salt int, term string, docs long"
_POSTINGS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("salt", pa.int32()), ("term", pa.string()), ("docs", pa.int64())])
COUNTS = "lang string, source string, term string, n long"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])


def folded(text: bytes) -> bytes:
    """A text's terms between single delimiters, small letters for A-Z; nothing for a text without terms."""
    terms = text.translate(FOLD).split()
    return b" %s " % b" ".join(terms) if terms else b""


def _postings(key: tuple, texts: pa.Table) -> pa.Table:
    """A block's terms with the number of its documents that have them."""
    counts: Counter[bytes] = Counter()
    for text in texts.column("text").to_pylist():
        counts.update(set(text.encode().translate(FOLD).split()))
    n = len(counts)
    lang, source, salt = (pa.repeat(k, n) for k in key)
    return pa.table([lang, source, salt, pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], schema=_POSTINGS)


def automaton_of(terms: list[str]) -> ahocorasick.Automaton:
    """Finds each padded term, valued by its place in the list."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(terms):
        automaton.add_word(f" {term} ", i)
    automaton.make_automaton()
    return automaton


def occurrences_in(automaton: ahocorasick.Automaton, text: str, n_terms: int) -> np.ndarray:
    """How often each term stands in a padded text."""
    return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=n_terms)


def _scan(key: tuple, texts: pa.Table, kept: pa.Table) -> pa.Table:
    """Occurrences of a block's kept terms in its texts, by an automaton of these terms."""
    terms = kept.column("term")
    automaton = automaton_of(terms.to_pylist())
    text = b"".join(folded(t.encode()) for t in texts.column("text").to_pylist()).decode()
    counts = occurrences_in(automaton, text, len(terms)) if len(terms) and text else np.zeros(len(terms), np.int64)
    return pa.table([pa.repeat(key[0], len(terms)), pa.repeat(key[1], len(terms)), terms, pa.array(counts)], schema=_COUNTS)


def blocks(documents: DataFrame, folder: str) -> DataFrame:
    """(lang, source, salt, text): documents dealt to blocks of about BLOCK_BYTES, each of one source.

    The number of a source's blocks follows from its bytes; doc_id and text choose the block, so copies of a text are spread.
    """
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    read = documents.select(empty("lang"), empty("source"), empty("text"), F.xxhash64("doc_id", "text").alias("h"))
    sizes = read.groupBy("lang", "source").agg(F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES).alias("n"))
    rows = read.join(written(sizes, folder, "sizes"), ["lang", "source"])
    return rows.select("lang", "source", F.pmod("h", F.greatest("n", F.lit(1))).cast("int").alias("salt"), "text").repartition(*BLOCK)


def occurrences(documents: DataFrame, folder: str, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n): how often each kept term occurs in each source that has it.

    Both passes read the same exchange of texts.
    """
    texts = blocks(documents, folder)
    postings = texts.groupBy(*BLOCK).applyInArrow(_postings, POSTINGS)
    frequency = F.sum("docs").over(Window.partitionBy("lang", "term"))
    kept = postings.withColumn("df", frequency).filter(F.col("df") >= min_documents).select(*BLOCK, "term")
    counts = texts.groupBy(*BLOCK).cogroup(kept.groupBy(*BLOCK)).applyInArrow(_scan, COUNTS)
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(10**9 * n / total) in whole numbers; the quotient is built three digits at a time, so that nothing overflows."""
    value, left = _div(n, total), F.pmod(n, total)
    for _ in range(3):
        value, left = value * 1000 + _div(left * 1000, total), F.pmod(left * 1000, total)
    return value + 1


def _div(a: Column, b: Column) -> Column:
    """The whole part of a / b of longs, neither below zero."""
    return F.call_function("div", a, b)


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """share() of an array."""
    value, left = n // total, n % total
    for _ in range(3):
        value, left = value * 1000 + left * 1000 // total, left * 1000 % total
    return value + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _pairs(key: tuple, postings: pa.Table, sources: pa.Table) -> pa.Table:
    """What the terms of one bucket add to the divergence of each ordered pair of sources of a pair of tiles.

    The amount that every absent term adds is counted once, in bucket 0, for all kept terms of the language.
    """
    bucket, lang, low, high = (k.as_py() for k in key)
    at = np.array(sources.column("at").to_pylist(), np.int64)
    order = np.argsort(at)
    at = at[order]
    n, size, tile = (np.array(sources.column(c).to_pylist(), np.int64)[order] for c in ("n_group", "n_terms", "tile"))
    names = sources.column("source").take(pa.array(order))
    width, kept = len(at), int(size[0])
    totals = n + kept
    base = np.array([shares(np.ones(1, np.int64), int(t))[0] if kept else 1 for t in totals])
    value = np.zeros((width, width), np.int64)
    none = gain(base[:, None], base[None, :])
    if bucket == 0 and kept:
        value += kept * none
    if postings.num_rows:
        place = np.searchsorted(at, np.array(postings.column("at").to_pylist(), np.int64))
        counts = postings.column("n").to_numpy().astype(np.int64)
        p = np.empty(len(counts), np.int64)
        for s in range(width):
            own = place == s
            if own.any():
                p[own] = shares(counts[own] + 1, int(totals[s]))
                levels, times = np.unique(p[own], return_counts=True)
                for i in range(0, len(levels), 4096):
                    a, m = levels[i : i + 4096, None], times[i : i + 4096, None]
                    value[s, :] += (m * (gain(a, base[None, :]) - none[s, :])).sum(0)
                    value[:, s] += (m * (gain(base[None, :], a) - none[:, s])).sum(0)
        terms = postings.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        rows = np.argsort(terms, kind="stable")
        terms, place, p = terms[rows], place[rows], p[rows]
        for shift in range(1, width):
            same = np.flatnonzero(terms[shift:] == terms[:-shift])
            if not len(same):
                break
            for a, b in ((same, same + shift), (same + shift, same)):
                more = gain(p[a], p[b]) - gain(p[a], base[place[b]]) - gain(base[place[a]], p[b]) + none[place[a], place[b]]
                np.add.at(value, (place[a], place[b]), more)
    first, second = np.divmod(np.arange(width * width), width)
    mine = first != second
    if low != high:
        mine &= tile[first] != tile[second]
    flat = value.ravel()
    mine &= (flat != 0) | (bucket == 0)
    first, second = pa.array(first[mine]), pa.array(second[mine])
    return pa.table([pa.array([lang] * len(first), pa.string()), names.take(first), names.take(second), pa.array(flat[mine])], schema=_PAIRS)


_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
PAIRS = "lang string, source string, item string, value long"


def audit(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences between sources, and the terms that set a source apart.

    Part `pair` ranks the other sources of a language by divergence from a source, part `term` the terms that a source has more
    of than its language, to term_ranks. A null text, lang or source counts as ''; a term must stand in min_documents rows of its
    language, repeated rows counted each; ties go to the smaller name in UTF-8 order. A language without kept terms has pairs of
    value 0. No documents give no rows. Columns besides text, lang and source have no effect.
    """
    spark = documents.sparkSession
    prepare(spark)
    folder = shared_dir(spark)
    counts = written(occurrences(documents, folder, min_documents), folder, "counts")
    n_buckets = max(1, -(-counts.count() // BUCKET_POSTINGS))
    groups = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_term"))
    by_lang = by_term.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n_term").alias("n_lang"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    sources = written(sources.select("lang", "source", zero("n_group"), zero("n_terms"), zero("n_lang"), place.cast("long").alias("at")), folder, "sources")
    return _pair_ranks(counts, sources, n_buckets).unionByName(_term_ranks(counts, sources, term_ranks))


def _pair_ranks(counts: DataFrame, sources: DataFrame, n_buckets: int) -> DataFrame:
    tiles = sources.groupBy("lang").agg(F.max(F.floor(F.col("at") / TILE)).alias("last"))

    def both_of(place: str) -> Column:
        """The pairs of tiles that a source takes part in."""
        tile = F.floor(F.col(place) / TILE)
        others = F.sequence(F.lit(0).cast("long"), F.col("last"))
        return F.transform(others, lambda x: F.struct(F.least(x, tile).alias("low"), F.greatest(x, tile).alias("high")))

    here = sources.select("lang", "source", F.col("at").alias("place"))
    left = counts.join(here, ["lang", "source"]).join(tiles, "lang")
    bucket = F.pmod(F.xxhash64("lang", "term"), F.lit(n_buckets))
    left = left.select(bucket.alias("bucket"), "lang", "term", F.col("place").alias("at"), "n", F.explode(both_of("place")).alias("t")).select("bucket", "lang", "t.low", "t.high", "term", "at", "n")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_buckets - 1).cast("long")))
    right = sources.join(tiles, "lang").select("*", F.explode(both_of("at")).alias("t")).select(every.alias("bucket"), "lang", "t.low", "t.high", "source", "at", F.floor(F.col("at") / TILE).alias("tile"), "n_group", "n_terms")
    key = ["bucket", "lang", "low", "high"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_pairs, PAIRS)
    summed = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.cast("int").alias("rank"))


def _term_ranks(counts: DataFrame, sources: DataFrame, ranks: int) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("lang", "term"))
    rows = counts.withColumn("n_term", total).join(sources, ["lang", "source"])
    p = share(F.col("n") + 1, F.col("n_group") + F.col("n_terms"))
    q = share(F.col("n_term") + 1, F.col("n_lang") + F.col("n_terms"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter(F.col("p") > F.col("q"))
    d = F.col("p") - F.col("q")
    rows = rows.select("lang", "source", "item", _div(d * d, F.col("q")).alias("value"), F.pmod(F.xxhash64("item"), F.lit(RANK_PARTS)).alias("bin"))
    best = [F.col("value").desc(), F.col("item")]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "bin").orderBy(*best))).filter(F.col("rank") <= ranks)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))).filter(F.col("rank") <= ranks)
    return last.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))


def oracle(min_documents: int = MIN_DOCUMENTS, ranks: int = TERM_RANKS) -> str:
    """DuckDB SQL for audit() of the table documents."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {min_documents}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
 1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (coalesce(gn.n, 0) + v.v)::HUGEINT AS p, 1 + 1000000000 * (kept.n + 1)::HUGEINT // (v.n + v.v)::HUGEINT AS q
 FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
 FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= {ranks}
"""
