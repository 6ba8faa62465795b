"""Personal data: patterns find protected entities, corpus co-occurrence finds the terms that give them away.

Patterns (mail addresses, network addresses, card and phone numbers) are found in whole texts, each kind leftmost and without
overlaps, then checked. What they find are the protected entities. Words close to an entity are counted corpus-wide: in how many
different contexts of the entity a term stands, and in how many different texts it stands without it. From these follows how
many bits about the entity are left once the term is known, -log2 of the (shrunken) chance that a text with the term holds the
entity. A term that leaves few bits discloses the entity wherever it stands: it is generalised, or removed if it leaves almost
none. Equal texts, and equal contexts as in near copies, count once, so copies of one text never make a term suspicious.

All of it is DataFrame functions. Positions come from the gaps between matches: a text's pieces and its matches alternate, so
running sums of their lengths give starts in code points.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, split_by_keys, written

#: Kinds of spans, in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: The patterns as the contract has them, for SQL and tests.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches in one pass: a match may begin where a run of its characters does, or where the last one ended, and runs give nothing back.
LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PATTERNS["phone"],
}
#: What a text needs for a match of the kind, cheap to look for: a character, or the beginning of a match in few steps.
NEEDS = {"email": "@", "phone": "+"}
NEEDS_PATTERN = {"ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}"}
#: Words that can be terms.
WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{3,}"

#: Code points on either side of an entity that are its context.
CONTEXT = 48
#: Least number of different contexts of an entity that a term must stand in.
MIN_CONTEXTS = 3
#: A term is generalised if the chance of the entity is at least 3/4 (0.42 bits are left), removed from 9/10 on (0.15 bits).
GENERALISE, REMOVE = (3, 4), (9, 10)
#: And only if the entity is at least 16 times as likely with the term as without (4 bits disclosed).
LIFT = 16
#: Chance is contexts / (contexts + other texts + SHRINK).
SHRINK = 1
SPANS = "array<struct<start:int,rank:int,end:int>>"
#: Lengths that one step of a running sum copies.
STEP = 128
#: Candidate terms that are sent along to all texts; where there are more, a filter of fixed size and a shuffled join find them.
SENT_TERMS = 100_000


def running(lengths: Column) -> Column:
    """Exclusive running sums of an array, in two levels, so that arrays of a million elements don't copy quadratically."""
    last = F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / STEP).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(lengths, i * STEP + 1, STEP))
    grow = lambda values, first: F.aggregate(values, F.array(first), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
    offsets = grow(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, v: acc + v)), F.lit(0))
    return F.flatten(F.zip_with(chunks, F.slice(offsets, 1, last + 1), lambda c, o: F.slice(grow(c, o), 1, F.size(c))))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(hit, r"\."), part)
    if kind == "card":
        digits = F.regexp_replace(hit, "[^0-9]", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def entity(kind: str, hit: Column) -> Column:
    """The name of what a match stands for."""
    name = F.lower(hit) if kind == "email" else hit if kind == "ip" else F.regexp_replace(hit, "[^0-9]", "")
    return F.concat(F.lit(f"{kind}:"), name)


def may_hold(kind: str) -> Column:
    return F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.col("text").rlike(NEEDS_PATTERN[kind])


def pieces(pattern: str, there: Column) -> tuple[Column, Column]:
    """(gaps, matches) of a pattern in the text, where it is there: one gap more than matches."""
    gaps, hits = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return F.when(there, gaps).otherwise(F.array()), F.when(there, hits).otherwise(F.array().cast("array<string>"))


def with_spans(docs: DataFrame, context: bool = False) -> DataFrame:
    """docs with `base`: the checked matches of all kinds (start, rank, end), by start, then kind; with context also entity and words around it."""
    found = docs
    for kind in KINDS:
        gaps, hits = pieces(LINEAR[kind], may_hold(kind))
        found = found.withColumn(f"_g_{kind}", gaps).withColumn(f"_h_{kind}", hits)
    for kind in KINDS:
        gaps, hits = F.col(f"_g_{kind}"), F.col(f"_h_{kind}")
        found = found.withColumn(f"_s_{kind}", running(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))))
    spans = []
    for rank, kind in enumerate(KINDS):
        gaps, hits = F.col(f"_g_{kind}"), F.col(f"_h_{kind}")
        n = F.size(hits)
        parts = F.arrays_zip(F.col(f"_s_{kind}").alias("at"), hits.alias("hit"), F.slice(gaps, 1, n).alias("before"), F.slice(gaps, 2, n).alias("after"))

        spans.append(F.transform(F.filter(parts, checked(kind)), spanned(rank, kind, context)))
    return found.withColumn("base", F.array_sort(F.concat(*spans))).drop(*(f"_{x}_{k}" for x in "ghs" for k in KINDS))


def checked(kind: str):
    return lambda p: valid(kind, p["hit"])


def spanned(rank: int, kind: str, context: bool):
    def span(p: Column) -> Column:
        start = p["at"] + F.length(p["before"])
        fields = [start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(p["hit"])).alias("end")]
        if context:
            fields += [entity(kind, p["hit"]).alias("entity"), around(p["before"], p["after"]).alias("around")]
        return F.struct(*fields)

    return span


def around(before: Column, after: Column) -> Column:
    """CONTEXT code points before and after, without the words that the cut goes through."""
    left = F.when(F.length(before) > CONTEXT, F.regexp_replace(F.right(before, F.lit(CONTEXT)), r"\A[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "")).otherwise(before)
    right = F.when(F.length(after) > CONTEXT, F.regexp_replace(F.left(after, F.lit(CONTEXT)), r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+\z", "")).otherwise(after)
    return F.concat(left, F.lit(" "), right)


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with two 64-bit hashes of the text: equal texts are one text."""
    return docs.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))


def weight() -> Column:
    """What contexts are measured against: themselves and the texts with the term but without the entity near it, shrunken."""
    return F.col("contexts") + F.col("texts") - F.col("together") + SHRINK


def reaches(chance: tuple[int, int]) -> Column:
    return F.col("contexts") * chance[1] >= chance[0] * weight()


def disclosing(docs: DataFrame, spans: DataFrame, folder: str) -> DataFrame:
    """(k1, k2, terms): the texts that hold disclosing terms, with them and whether they are to be removed.

    docs has text, k1 and k2; spans the base spans with their contexts of those that have some.
    """
    spotted = spans.select("k1", "k2", F.explode("base").alias("s"))
    near = spotted.select("k1", "k2", "s.entity", F.xxhash64("s.around").alias("context"), F.explode(words(F.col("s.around"))).alias("term"))
    near = written(near.distinct(), folder, "near")
    support = near.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("k1", "k2").alias("together"))
    # texts with the term in anyone's context are some of all texts with it: what fails with them fails with all
    seen = near.groupBy("term").agg(F.count_distinct("k1", "k2").alias("texts"))
    candidates = written(support.filter(F.col("contexts") >= MIN_CONTEXTS).join(seen, "term").filter(reaches(GENERALISE)).drop("texts"), folder, "candidates")
    # texts that hold a candidate term
    tokens = docs.select("k1", "k2", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("term"))
    wanted = candidates.select("term").distinct()
    if wanted.count() <= SENT_TERMS:
        wanted = F.broadcast(wanted)
    else:
        tokens, _ = split_by_keys(tokens, F.xxhash64("term"), wanted.select(F.xxhash64("term").alias("k")), folder, "terms")
    held = written(tokens.join(wanted, "term", "left_semi").distinct(), folder, "held")
    texts = docs.select("k1", "k2").distinct().count()
    with_entity = near.select("entity", "k1", "k2").distinct().groupBy("entity").agg(F.count("*").alias("entity_texts"))
    rated = candidates.join(held.groupBy("term").agg(F.count("*").alias("texts")), "term").join(with_entity, "entity")
    lifted = F.col("contexts") * texts >= LIFT * F.col("entity_texts") * weight()
    flagged = written(rated.filter(lifted & reaches(GENERALISE)).groupBy("term").agg(F.max(reaches(REMOVE)).alias("remove")), folder, "flagged")
    return held.join(flagged, "term").groupBy("k1", "k2").agg(F.collect_list(F.struct("term", "remove")).alias("terms"))


def scan(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, all other columns) with `base` and `found`: arrays of spans (start, rank, end), found also with terms.

    A null text is empty. A term inside a base span isn't listed again. Repeated rows are judged each, but count as one text.
    Columns of documents that are called base, found, terms, k1 or k2 are replaced.
    """
    spark = documents.sparkSession
    folder = shared_dir(spark)
    docs = keyed(documents.drop("base", "found", "terms").withColumn("text", F.coalesce("text", F.lit(""))))
    some = reduce(or_, map(may_hold, KINDS))
    spans = written(with_spans(docs.filter(some).select("text", "k1", "k2"), context=True).select("k1", "k2", "base"), folder, "spans")
    hits = disclosing(docs.select("text", "k1", "k2"), spans, folder)
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    spotted = spans.filter(F.size("base") > 0).select("k1", "k2", plain.alias("base")).dropDuplicates(["k1", "k2"])
    no_spans, no_terms = F.array().cast(SPANS), F.array().cast("array<struct<term:string,remove:boolean>>")
    marks = spotted.join(hits, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("base", no_spans).alias("base"), F.coalesce("terms", no_terms).alias("terms"))
    marks = written(marks, folder, "marks")
    # texts without spans and terms, but for a filter's errors, aren't moved
    maybe, rest = split_by_keys(docs, F.col("k1"), marks.select(F.col("k1").alias("k")), folder, "texts")
    joined = maybe.join(marks, ["k1", "k2"], "left")
    given = joined.withColumns({"base": F.coalesce("base", no_spans), "terms": F.coalesce("terms", no_terms)}).select(*rest.columns, "base", "terms")
    gaps, held = pieces(WORD, F.size("terms") > 0)
    given = given.withColumn("_h", held).withColumn("_g", gaps)
    given = given.withColumn("_s", running(F.zip_with(F.slice("_g", 1, F.size("_h")), "_h", lambda g, h: F.length(g) + F.length(h))))
    parts = F.arrays_zip(F.col("_s").alias("at"), F.col("_h").alias("hit"), F.slice("_g", 1, F.size("_h")).alias("before"))
    names, gone = F.transform("terms", lambda t: t["term"]), F.transform(F.filter("terms", lambda t: t["remove"]), lambda t: t["term"])

    def span(p: Column) -> Column:
        start = p["at"] + F.length(p["before"])
        rank = F.when(F.array_contains(gone, p["hit"]), len(KINDS) + 1).otherwise(len(KINDS))
        return F.struct(start.alias("start"), rank.alias("rank"), (start + F.length(p["hit"])).alias("end"))

    own = F.transform(F.filter(parts, lambda p: F.array_contains(names, p["hit"])), span)
    free = F.filter(own, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    given = given.withColumn("found", F.array_sort(F.concat("base", free))).drop("_h", "_g", "_s", "terms")
    clean = rest.withColumns({"base": no_spans, "found": no_spans})
    return given.unionByName(clean).drop("k1", "k2")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kind = lambda s: F.element_at(F.array(*(F.lit(k) for k in (*KINDS, TERM, TERM))), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_rank(rank: int):
    return lambda s: s["rank"] == rank


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the four kinds, a digest of the base spans, and all spans as text."""
    counts = [F.size(F.filter("base", of_rank(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return scanned.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def sanitised(scanned: DataFrame) -> DataFrame:
    """The rows with `clean`: the text with entities as `[email]` and so on, generalised terms as `[name]` or `[word]`, others cut out.

    Where spans overlap, the first one stands for both.
    """
    letters = F.split("text", "")
    first = F.aggregate("found", F.array().cast(SPANS), lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]), acc).otherwise(F.concat(acc, F.array(s))))
    rows = scanned.withColumn("_c", F.when(F.length("text") > 0, letters).otherwise(F.array().cast("array<string>"))).withColumn("_f", first)
    ends = F.concat(F.array(F.lit(0)), F.transform("_f", lambda s: s["end"]))
    starts = F.concat(F.transform("_f", lambda s: s["start"]), F.array(F.length("text")))
    kept = F.zip_with(ends, starts, lambda a, b: F.array_join(F.slice("_c", a + 1, F.greatest(b - a, F.lit(0))), ""))

    def instead(s: Column) -> Column:
        term = F.when(F.element_at("_c", s["start"] + 1).rlike("^[A-Z]"), "[name]").otherwise("[word]")
        entity_ = F.element_at(F.array(*(F.lit(f"[{k}]") for k in KINDS), F.lit(""), F.lit("")), s["rank"] + 1)
        return F.when(s["rank"] < len(KINDS), entity_).when(s["rank"] == len(KINDS), term).otherwise("")

    marks = F.concat(F.transform("_f", instead), F.array(F.lit("")))
    return rows.withColumn("clean", F.array_join(F.zip_with(kept, marks, lambda k, m: F.concat(k, m)), "")).drop("_c", "_f")


def oracle() -> str:
    """DuckDB SQL for digests(scan()) of the table documents."""
    q = lambda s: s.replace("'", "''")
    kinds = []
    for rank, kind in enumerate(KINDS):
        check = {
            "email": "true",
            "ip": "list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) <= 255))",
            "card": "length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(generate_series(1, length(digits)), lambda j: CASE WHEN (length(digits) - j) % 2 = 0 THEN digits[j]::INTEGER WHEN digits[j]::INTEGER > 4 THEN digits[j]::INTEGER * 2 - 9 ELSE digits[j]::INTEGER * 2 END)) % 10 = 0",
            "phone": "length(digits) BETWEEN 10 AND 15",
        }[kind]
        name = {"email": "lower(hit)", "ip": "hit"}.get(kind, "digits")
        kinds.append(f"""SELECT rid, text, {rank} AS rank, '{kind}' AS kind, begin + length(before) AS start, begin + length(before) + length(hit) AS stop, '{kind}:' || {name} AS entity, before, after FROM (
 SELECT rid, text, h[i] AS hit, regexp_replace(h[i], '[^0-9]', '', 'g') AS digits, g[i] AS before, g[i + 1] AS after, coalesce(list_sum(list_transform(g[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS begin
 FROM (SELECT rid, text, g, h, unnest(generate_series(1, len(h))) AS i FROM (SELECT rid, text, regexp_split_to_array(text, '{q(PATTERNS[kind])}') AS g, regexp_extract_all(text, '{q(PATTERNS[kind])}') AS h FROM d))) WHERE {check}""")
    letters = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    around_ = f"CASE WHEN length(before) > {CONTEXT} THEN regexp_replace(right(before, {CONTEXT}), '^{letters}', '') ELSE before END || ' ' || CASE WHEN length(after) > {CONTEXT} THEN regexp_replace(left(after, {CONTEXT}), '{letters}$', '') ELSE after END"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED ({' UNION ALL '.join(kinds)}),
near AS (SELECT DISTINCT entity, context, text, term FROM (SELECT entity, context, text, unnest(regexp_extract_all(context, '{WORD}')) AS term FROM (SELECT entity, text, {around_} AS context FROM base))),
candidates AS (SELECT entity, term, count(DISTINCT context) AS contexts, count(DISTINCT text) AS together FROM near GROUP BY ALL HAVING count(DISTINCT context) >= {MIN_CONTEXTS}),
tokens AS MATERIALIZED (SELECT rid, text, h[i] AS term, i, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS start
 FROM (SELECT rid, text, g, h, unnest(generate_series(1, len(h))) AS i FROM (SELECT rid, text, regexp_split_to_array(text, '{WORD}') AS g, regexp_extract_all(text, '{WORD}') AS h FROM d)) WHERE h[i] IN (SELECT term FROM candidates)),
texts AS (SELECT term, count(DISTINCT text) AS n FROM tokens GROUP BY term),
entities AS (SELECT entity, count(DISTINCT text) AS n FROM near GROUP BY entity),
flagged AS (SELECT DISTINCT c.term FROM candidates c JOIN texts t USING (term) JOIN entities e USING (entity)
 WHERE c.contexts * (SELECT count(DISTINCT text) FROM d) >= {LIFT} * e.n * (c.contexts + t.n - c.together + {SHRINK}) AND c.contexts * {GENERALISE[1]} >= {GENERALISE[0]} * (c.contexts + t.n - c.together + {SHRINK})),
terms AS (SELECT rid, {len(KINDS)} AS rank, '{TERM}' AS kind, start, start + length(term) AS stop FROM tokens t WHERE term IN (SELECT term FROM flagged)
 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = t.rid AND b.start < t.start + length(t.term) AND t.start < b.stop)),
spans AS (SELECT rid, rank, kind, start, stop FROM base UNION ALL SELECT rid, rank, kind, start, stop FROM terms),
told AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(KINDS)}) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (rid)
"""
