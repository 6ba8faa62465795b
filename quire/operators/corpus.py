"""Ordering, identity, linking and diagnostics over tables of chapters, pages and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_even, natural_key, ordered_concat, roman_rank, strip
from ..session import scratch, written


def repeated(items: DataFrame, doc: str, page: str, key: Column, fraction: float) -> DataFrame:
    """(doc, key) of what stands on max(2, half-even(pages * fraction)) distinct pages of a document; none under two pages."""
    pages = items.groupBy(doc).agg(F.count_distinct(page).alias("_pages"))
    counts = items.select(doc, page, key.alias("key")).filter("key is not null and key <> ''").groupBy(doc, "key").agg(F.count_distinct(page).alias("_n"))
    least = F.greatest(F.lit(2), half_even(F.col("_pages") * F.lit(fraction)))
    return counts.join(pages, doc).filter((F.col("_pages") >= 2) & (F.col("_n") >= least)).select(doc, "key")


def strip_repeated_lines(lines: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(doc, page, text) without the lines that recur as page furniture; table rows always stay, and so do empty pages."""
    stripped = strip(F.col("line"))
    table_row = stripped.rlike("^\\|.*\\|$")
    found = repeated(lines.filter(~table_row), "doc", "page", stripped, fraction).withColumnRenamed("key", "_key")
    keyed = lines.withColumn("_key", F.when(table_row, F.lit(None)).otherwise(stripped))
    kept = keyed.join(found, ["doc", "_key"], "left_anti").groupBy("doc", "page").agg(ordered_concat(F.col("line"), [F.col("ln")], "\n").alias("text"))
    return lines.select("doc", "page").distinct().join(kept, ["doc", "page"], "left").select("doc", "page", F.coalesce("text", F.lit("")).alias("text"))


def bullet_chars(lines: DataFrame, least: int = 5) -> DataFrame:
    """(doc, ch): single letters or private-use glyphs that start many lines of a document, except a and i."""
    ch = F.lower(F.regexp_extract(strip(F.col("line")), "^([A-Za-z\\ue000-\\uf8ff])\\s+\\S", 1))
    return lines.select("doc", ch.alias("ch")).filter(~F.col("ch").isin("", "a", "i")).groupBy("doc", "ch").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def leading_number(name: Column) -> Column:
    return F.regexp_extract(name, "^(\\d+)", 1).try_cast("int")


def by_convention(chapters: DataFrame) -> DataFrame:
    """Rows that a tree's naming places: section (0 front files, 1 parts, 2 back matter, 3 appendix), label, and _rank and _key to sort by."""
    name, top = file_name(F.col("path")), F.regexp_extract("path", "^([^/]+)/", 1)
    part = F.regexp_extract(top, "^Part_([IVX]+)_", 1)
    number = leading_number(name)
    section = (
        F.when((top == "") & (F.coalesce(number, F.lit(0)) < 50), 0).when(top.rlike("^Part_[IVX]+_"), 1).when(top == "", 2).when(F.lower(top) == "appendix", 3)
    )
    label = F.when(section == 1, F.concat(part, F.lit("부. "), F.replace(F.regexp_extract(top, "^Part_[IVX]+_(.*)$", 1), F.lit("_"), F.lit(" ")))).when(section == 3, F.lit("Appendix"))
    c = chapters.withColumn("section", section).withColumn("label", label).filter("section is not null")
    return c.withColumn("_rank", F.when(F.col("section") == 1, roman_rank(part)).otherwise(0)).withColumn("_key", natural_key(F.col("path")))


def convention_order(chapters: DataFrame) -> DataFrame:
    """Reading order of a tree by naming: front files, parts by numeral, back matter, appendix. Other folders don't count.

    Adds section (0 to 3), label and reading position `pos_out`.
    """
    # ranked in ranges of the sort key: counts of the ranges before are added, so the whole isn't sorted in one task
    return ranked(by_convention(chapters), ["section", "_rank", "_key", "path", "pos"], "pos_out").drop("_rank", "_key")


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds the 1-based place in a total order, by a range partitioning and counts per range.

    The ranges come from a sample, so the dealt rows are written once: counts and places must see the same ranges.
    """
    spread = written(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    # one row per range: the broadcast grows with the number of partitions alone
    return spread.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def numbered(df: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """row_number() within keys for keys that may hold a large share of all rows: places in the total order, less the key's first."""
    placed = ranked(df, [*keys, *by], "_place")
    first = placed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_place").alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return placed.join(first, same).withColumn(name, (F.col("_place") - F.col("_first") + 1).cast("int")).drop("_place", "_first", *[f"_k{i}" for i in range(len(keys))])


def explicit_order(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern_ix, path): listed names as they are, globs in natural order; duplicates stay, exclusions don't apply."""
    spark = files.sparkSession
    rows = [(i, p, glob_regex(p) if any(c in p for c in "*?[") else None) for i, p in enumerate(patterns)]
    listed = spark.createDataFrame(rows, "pattern_ix int, pattern string, re string")
    hit = F.when(F.col("re").isNull(), F.col("path") == F.col("pattern")).otherwise(F.regexp_like("path", F.col("re")))
    return files.join(F.broadcast(listed), hit).select("pattern_ix", "path")


def glob_regex(pattern: str, name_only: bool = False) -> str:
    """A glob as a regex; * and ? stop at a slash unless only names are matched."""
    import re

    out, i = [], 0
    any_char = "." if name_only else "[^/]"
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out.append(f"{any_char}*")
        elif c == "?":
            out.append(any_char)
        elif end > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def excluded(chapters: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows whose file name matches none of the globs."""
    out = chapters
    for p in patterns:
        out = out.filter(~file_name(F.col("path")).rlike(glob_regex(p, name_only=True)))
    return out


def dedupe_suffix(rows: DataFrame, key: str, by: str) -> DataFrame:
    """suffix: '' for the first of a key, then -2, -3 in order; the result isn't checked again."""
    n = F.col("_n")
    return numbered(rows, [key], [by], "_n").withColumn("suffix", F.when(n == 1, F.lit("")).otherwise(F.concat(F.lit("-"), n.cast("string")))).drop("_n")


def part_headings(chapters: DataFrame, keys: list[str], by: str, nulls_count: bool) -> DataFrame:
    """heading: the label where it changes. With nulls_count a missing label in between starts it anew."""
    w = Window.partitionBy(*keys).orderBy(by)
    label = F.col("part_label")
    before = F.lag("part_label").over(w) if nulls_count else F.last("part_label", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return chapters.withColumn("heading", F.when(label.isNotNull() & ~label.eqNullSafe(before), label))


def page_offsets(chapters: DataFrame, keys: list[str], by: str, pages: Column) -> DataFrame:
    """offset: pages of all chapters before."""
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return chapters.withColumn("page_count", pages).withColumn("offset", F.coalesce(F.sum("page_count").over(w), F.lit(0)))


def duplicate_titles(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """Titles of more than one chapter, with the paths in order."""
    g = chapters.filter("title <> ''").groupBy(*keys, "title").agg(F.count(F.lit(1)).alias("n"), ordered_concat(F.col("path"), [F.col("pos")], ";").alias("paths"))
    return g.filter("n > 1")


def normalised_path(base: Column, href: Column) -> Column:
    """A relative reference against the folder of a page: `.` goes, `..` takes the folder before with it."""
    joined = F.split(F.concat_ws("/", F.nullif(base, F.lit("")), href), "/")
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1)).when(x == "..", acc).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(joined, F.array().cast("array<string>"), step), "/")


def resolve_links(links: DataFrame, sections: DataFrame, by: list[str]) -> DataFrame:
    """target: `#sid` of the section that a link's path names, else the link as it is; the first piece of a file wins."""
    first = sections.groupBy("path").agg(F.min_by("sid", "pos").alias("sid"))
    skip = F.col("href").rlike("^(https?://|data:|#|mailto:)")
    path = F.regexp_replace("href", "#.*$", "")
    keyed = links.withColumn("_path", F.when(~skip & path.endswith(".md"), normalised_path(F.col("folder"), path)))
    joined = keyed.join(first.withColumnRenamed("path", "_path"), "_path", "left")
    return joined.select(*by, "href", F.when(F.col("sid").isNotNull(), F.concat(F.lit("#"), F.col("sid"))).otherwise(F.col("href")).alias("target"))


def missing_references(refs: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """References (src) that name no file; duplicates stay. Those that match the pattern aren't files."""
    return refs.filter(~F.col("src").rlike(pattern)).join(files.select(F.col("path").alias("src")).distinct(), "src", "left_anti")


def interval_union(bands: DataFrame, key: str) -> DataFrame:
    """Merged intervals of a key: one that starts no later than the furthest end so far (touching counts) goes on."""
    before = Window.partitionBy(key).orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    flagged = bands.withColumn("_new", F.when(F.col("y0") > F.max("y1").over(before), 1).otherwise(0))
    upto = Window.partitionBy(key).orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn("_island", F.sum("_new").over(upto)).groupBy(key, "_island").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")).drop("_island")


def page_slice(rows: DataFrame, by: list[str], page: int, per_page: int) -> DataFrame:
    """One page of an ordered list, with total and pages (at least 1). A page is the feature, so this is a limit."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    wanted = rows.orderBy(*by).offset((page - 1) * per_page).limit(per_page)
    return wanted.join(F.broadcast(total)).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)))


def rank_matched(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str) -> DataFrame:
    """The k-th row of a key on the left with the k-th on the right (first in, first out)."""
    number = lambda df, by: df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(by)))
    return number(left, left_by).join(number(right, right_by), [key, "_k"]).drop("_k")


#: Lengths of the keys by which needles are looked up, from a beginning of a word on, the more selective one first.
ANCHORS = (24, 12)
#: A text of 29 characters without a beginning of a word behind its first character has such a run of one kind.
_RUN = "\\S{15}|\\s{15}"


def first_contained(needles: DataFrame, texts: DataFrame, head: int = 40) -> DataFrame:
    """(needle_id, text_id): the first text that holds the first `head` characters of the needle.

    Needles that are equal in these are looked up once. Candidates are found by an equality on short substrings, not by comparing
    all pairs. A key begins where a word does, so a text has one a word and not one a character; of these only hashes are moved,
    and only those that a filter of fixed size lets pass. Needles without such a place hold a long run of one kind and are looked
    up at every character of such runs; the few that are too short for either, at every character. Needles that are shorter than a
    key are few and compared by themselves. Texts are only read for those kinds of needles that there are.
    """
    k = ANCHORS[-1]
    probe = needles.select("needle_id", F.substring("code", 1, head).alias("_head")).filter(F.length("_head") > 0)
    heads = written(probe.select("_head").distinct())
    open_, hits = heads.filter(F.length("_head") >= k), []
    for n in ANCHORS:
        # pieces of a text from one beginning of a word to the next have two characters at least
        pieces = F.split("body", "(?<=\\s)(?=\\S)")
        grams = F.transform("pieces", lambda _, i: F.xxhash64(F.substring(F.array_join(F.slice("pieces", i + 1, n // 2), ""), 1, n)))  # noqa: B023
        placed = open_.withColumn("_anchor", F.regexp_extract("_head", f"(?s)\\s(\\S.{{{n - 1}}})", 1))
        found = texts.select("text_id", pieces.alias("pieces")).select("text_id", F.explode(F.array_distinct(grams)).alias("_gram"))
        hits.append(_held(_keyed(placed.filter("_anchor <> ''"), "_anchor"), found, texts))
        open_ = placed.filter("_anchor = ''").drop("_anchor")
    every = lambda c: F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    hashed = lambda grams: F.explode(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))).alias("_gram")
    placed = open_.withColumn("_anchor", F.substring(F.regexp_extract("_head", f"({_RUN})", 1), 1, k))
    runs = F.regexp_extract_all("body", F.lit("(\\S{15,}|\\s{15,})"), F.lit(1))
    found = texts.filter(F.col("body").rlike(_RUN)).select("text_id", hashed(F.flatten(F.transform(runs, every))))
    hits.append(_held(_keyed(placed.filter("_anchor <> ''"), "_anchor"), found, texts))
    short = placed.filter("_anchor = ''").withColumn("_anchor", F.substring("_head", 1, k))
    hits.append(_held(_keyed(short, "_anchor"), texts.select("text_id", hashed(every(F.col("body")))), texts))
    few = heads.filter(F.length("_head") < k)
    hits.append(None if few.isEmpty() else few.join(texts, F.contains("body", "_head")).select("_head", "text_id"))
    made = [h for h in hits if h is not None] or [heads.select("_head", F.lit(None).cast(texts.schema["text_id"].dataType).alias("text_id")).limit(0)]
    first = reduce(DataFrame.union, made).groupBy("_head").agg(F.min("text_id").alias("text_id"))
    return probe.join(first, "_head").groupBy("needle_id").agg(F.min("text_id").alias("text_id"))


def _keyed(needles: DataFrame, anchor: str) -> DataFrame:
    return needles.select("_head", F.xxhash64(anchor).alias("_gram"))


def _held(needles: DataFrame, grams: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(_head, text_id) of needles (_head, _gram) in those texts with their key (text_id, _gram) that hold them; None without needles."""
    from ..llm.common import split_by_keys

    keys = written(needles.select(F.col("_gram").alias("k")).distinct())
    if keys.isEmpty():
        return None
    near, _ = split_by_keys(grams, F.col("_gram"), keys, scratch(keys.sparkSession), "filter")
    asked = needles.join(near, "_gram").select("_head", "text_id")
    return asked.join(texts, "text_id").filter(F.contains("body", "_head")).select("_head", "text_id")
