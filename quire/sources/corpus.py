"""Corpus trees as tables: Markdown files, their order by tier, and the book's configuration."""

from __future__ import annotations

import io
import re
import unicodedata
from dataclasses import dataclass, field, fields

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.text import ROMAN, natural_key, nfc
from ..operators import corpus as C
from ..session import written

# Files that aren't chapters unless a book says otherwise.
DEFAULT_EXCLUDE = ["book.yaml", "README.md", "readme.md"]


@dataclass
class Order:
    manifest: str | None = None
    files: list[str] = field(default_factory=list)


@dataclass
class Split:
    files: list[str] = field(default_factory=list)
    heading_level: int = 2


@dataclass
class Translation:
    model: str | None = None
    host: str | None = None
    timeout: int = 300
    chunk_chars: int = 2000
    temperature: float | None = None
    num_ctx: int | None = None


@dataclass
class Book:
    title: str | None = None
    author: str | None = None
    language: str = "ko"
    exclude: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDE))
    order: Order = field(default_factory=Order)
    tip_markers: list[str] = field(default_factory=list)
    section_id_overrides: dict[str, str] = field(default_factory=dict)
    custom_css: str | None = None
    color: str | None = None
    translation: Translation = field(default_factory=Translation)
    split: Split = field(default_factory=Split)


def read_book(text: str | None) -> Book | None:
    """A book.yaml as a Book. None if absent or not readable; unknown keys are ignored at the top and errors below it."""
    if text is None:
        return None
    try:
        raw = yaml.safe_load(text) or {}
    except yaml.YAMLError:
        return None
    nested = {"order": Order, "split": Split, "translation": Translation}
    known = {f.name for f in fields(Book)}
    values = {k: nested[k](**v) if k in nested and v else v for k, v in raw.items() if k in known and v is not None}
    if isinstance(raw.get("callouts"), dict):
        values["tip_markers"] = raw["callouts"].get("tip_markers") or []
    if isinstance(values.get("section_id_overrides"), dict):
        values["section_id_overrides"] = {unicodedata.normalize("NFC", str(k)): v for k, v in values["section_id_overrides"].items()}
    return Book(**values)


def write_book(language: str, **extra) -> str:
    """A minimal book.yaml: the language, then what else is given."""
    return _dumped({"language": language, **extra})


def _dumped(values: dict) -> str:
    out = io.StringIO()
    yaml.safe_dump(values, out, allow_unicode=True, sort_keys=False)
    return out.getvalue()


def in_language(text: str | None, language: str) -> str:
    """A book.yaml with its language replaced, other keys in their order (comments go); a minimal one if there is none."""
    raw = yaml.safe_load(text) if text is not None else None
    return _dumped({**(raw or {}), "language": language})


def configurations(books: DataFrame, language: str, config: str = "config") -> DataFrame:
    """books with their configuration (a book.yaml as text, or null) in another language."""

    def run(frames):
        for f in frames:
            f[config] = [in_language(x, language) for x in f[config]]
            yield f

    return books.mapInPandas(run, books.schema)


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of every Markdown file below a folder, the path relative to it and composed to NFC."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/").removeprefix("file:")
    after = F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})")
    return files.select(nfc(after).alias("path"), F.decode("content", "UTF-8").alias("text"))


def toc_rows(files: DataFrame) -> DataFrame:
    """(pos, part_no, part_title, chapter_no) of the first root file with a toc fence; lines need four fields."""
    fence = "(?s)```toc\\s*\\n(.*?)```"
    found = files.filter((~F.contains("path", F.lit("/"))) & F.col("text").rlike(fence))
    first = found.agg(F.min_by("text", "path").alias("text"))
    lines = first.select(F.posexplode(F.split(F.regexp_extract("text", fence, 1), "\n")).alias("pos", "line"))
    parts = lines.withColumn("f", F.split(F.trim("line"), "\\|")).filter(F.size("f") >= 4)
    return parts.select("pos", F.col("f")[0].alias("part_no"), F.col("f")[1].alias("part_title"), F.col("f")[2].alias("chapter_no"))


def toc_order(files: DataFrame) -> DataFrame:
    """(pos, path, part_label) in the order of the toc; entries without a file are left out."""
    rows = toc_rows(files)
    romans = F.create_map(*[F.lit(x) for k, v in ROMAN.items() for x in (str(v), k)])
    rows = rows.withColumn("alt", F.coalesce(romans[F.col("part_no")], F.col("part_no")))
    split = files.select("path").withColumn("folder", F.regexp_extract("path", "^([^/]*)/[^/]*$", 1)).withColumn("stem", F.concat(F.regexp_extract("path", "([^/]*)\\.md$", 1), F.lit("_")))
    # a toc has as many rows as a book has chapters, so it is the side that is sent along
    in_part = F.regexp_like(F.concat("folder", F.lit("_")), F.concat(F.lit("^Part_?0*(?:"), "part_no", F.lit("|"), "alt", F.lit(")\\D"))) & (F.col("folder") != "")
    named = F.regexp_like("stem", F.concat(F.lit("^Chapter_?0*"), "chapter_no", F.lit("\\D")))
    parts = rows.join(split.select("folder").distinct(), in_part, "left").groupBy("pos").agg(F.collect_set("folder").alias("folders"))
    r = rows.join(parts, "pos")
    place = F.array_contains("folders", F.col("folder")) | ((F.size("folders") == 0) & (F.col("folder") == ""))
    hit = r.join(split, place & named).groupBy("pos", "part_no", "part_title").agg(F.min("path").alias("path"))
    return hit.select("pos", "path", F.concat(F.lit("Part "), "part_no", F.lit(". "), "part_title").alias("part_label"))


def resolve(files: DataFrame, book: Book | None) -> tuple[DataFrame, str]:
    """(pos_out, path, part_label) by the first tier that has chapters, and the tier: explicit, toc, convention or natural.

    Exclusions apply to the last two tiers only. Whether a tier has rows is looked up tier by tier, which reads a listing.
    """
    book = book or Book()
    empty = F.lit(None).cast("string").alias("part_label")
    if book.order.files and not book.order.manifest:
        listed = C.explicit_order(files, book.order.files).withColumn("_key", natural_key(F.col("path")))
        out = C.ranked(listed, ["pattern_ix", "_key", "path"], "pos_out").select("pos_out", "path", empty)
        if not out.isEmpty():
            return out, "explicit"
    if book.order.manifest:
        out = toc_order(files.filter((F.col("path") == book.order.manifest) | ~F.col("text").rlike("```toc\\s*\\n")))
    else:
        out = toc_order(files)
    if not out.isEmpty():
        return out.withColumnRenamed("pos", "pos_out"), "toc"
    kept = C.excluded(files, book.exclude).withColumn("pos", F.lit(0))
    if not kept.filter("path rlike '^Part_[IVX]+_'").isEmpty():
        return C.convention_order(kept).select("pos_out", "path", F.col("label").alias("part_label")), "convention"
    keyed = kept.withColumn("_key", natural_key(F.col("path")))
    return C.ranked(keyed, ["_key", "path"], "pos_out").select("pos_out", "path", empty), "natural"


# --- many books at once ------------------------------------------------------------------------------------------------------

TIERS = ("explicit", "toc", "convention", "natural")


def book_orders(books: DataFrame, config: str = "config") -> DataFrame:
    """(book, exclude, files, manifest): what a book's configuration (a book.yaml as text, or null) says of its order."""

    def run(frames):
        for f in frames:
            out = []
            for book, text in zip(f["book"], f["config"]):
                b = read_book(text) or Book()
                out.append((book, list(b.exclude), list(b.order.files), b.order.manifest))
            yield pd.DataFrame(out, columns=["book", "exclude", "files", "manifest"])

    kind = dict(books.dtypes)["book"]
    return books.select("book", F.col(config).alias("config")).mapInPandas(run, f"book {kind}, exclude array<string>, files array<string>, manifest string")


@F.pandas_udf(BooleanType())
def glob_matches(name: pd.Series, pattern: pd.Series) -> pd.Series:
    """Whether a path is what a pattern names: as it is, or as a glob whose wildcards stop at a slash."""
    return pd.Series([bool(re.match(C.glob_regex(p), n)) if any(c in p for c in "*?[") else n == p for n, p in zip(name, pattern)])


@F.pandas_udf(BooleanType())
def any_glob(name: pd.Series, patterns: pd.Series) -> pd.Series:
    return pd.Series([any(re.match(C.glob_regex(p, name_only=True), n) for p in ps) for n, ps in zip(name, patterns)])


def toc_entries(files: DataFrame) -> DataFrame:
    """(book, pos, part_no, part_title, chapter_no): the toc fence of each book's first file, in the order of paths, that has one."""
    fence = "(?s)```toc\\s*\\n(.*?)```"
    first = files.filter(F.col("text").rlike(fence)).groupBy("book").agg(F.min_by("text", "path").alias("text"))
    lines = first.select("book", F.posexplode(F.split(F.regexp_extract("text", fence, 1), "\n")).alias("pos", "line"))
    f = F.col("f")
    return lines.withColumn("f", F.split(F.trim("line"), "\\|")).filter(F.size("f") >= 4).select("book", "pos", f[0].alias("part_no"), f[1].alias("part_title"), f[2].alias("chapter_no"))


def resolve_books(files: DataFrame, books: DataFrame) -> DataFrame:
    """(book, tier, pos_out, path, part_label): the chapters of many books (book, path, text), each by its first tier that has some.

    books is (book, config). A listing in the configuration comes first, then a toc (the file that the configuration names, or any
    in the root), then naming by parts and chapters, then natural order; exclusions hold for the last two. Tiers are ranked
    relations over all books, and a book takes the lowest that isn't empty.
    """
    orders = book_orders(books)
    known = files.select("book", "path", "text").join(orders, "book", "left")
    key = natural_key(F.col("path"))
    none = F.lit(None).cast("string").alias("part_label")
    listed = known.filter(F.col("manifest").isNull() & (F.size("files") > 0)).select("book", "path", F.posexplode("files").alias("ix", "pattern")).filter(glob_matches("path", "pattern"))
    explicit = listed.select("book", F.lit(0).alias("tier"), F.struct(F.col("ix").cast("long").alias("a"), key.alias("k")).alias("at"), "path", none)
    root = known.filter(~F.contains("path", F.lit("/")) & (F.col("manifest").isNull() | (F.col("path") == F.col("manifest"))))
    rows = toc_entries(root.select("book", "path", "text"))
    romans = F.create_map(*[F.lit(x) for k, v in ROMAN.items() for x in (str(v), k)])
    rows = rows.withColumn("alt", F.coalesce(romans[F.col("part_no")], F.col("part_no")))
    placed = files.select("book", "path", F.regexp_extract("path", "^([^/]*)/[^/]*$", 1).alias("folder"), F.concat(F.regexp_extract("path", "([^/]*)\\.md$", 1), F.lit("_")).alias("stem"))
    # numerals are compared whole, zeros before them aside: an entry meets the files of its own number alone
    bare = lambda c: F.regexp_replace(c, "^0+(?=.)", "")
    numeral = "_?0*([0-9]+|[^0-9_]+)"
    placed = placed.withColumns({"folder_no": F.regexp_extract(F.concat("folder", F.lit("_")), f"^Part{numeral}(?=\\D)", 1), "file_no": F.regexp_extract("stem", f"^Chapter{numeral}(?=\\D)", 1)})
    rows = rows.withColumns({"file_no": bare("chapter_no"), "numerals": F.array_distinct(F.array(bare("part_no"), "alt"))})
    meant = rows.select("*", F.explode("numerals").alias("folder_no"))
    parts = meant.join(placed.filter("folder_no <> ''").select("book", "folder_no").distinct(), ["book", "folder_no"], "left_semi").select("book", "pos").distinct()
    in_parts = meant.join(placed.filter("folder_no <> '' and file_no <> ''"), ["book", "folder_no", "file_no"])
    loose = rows.join(parts, ["book", "pos"], "left_anti").join(placed.filter("folder = '' and file_no <> ''"), ["book", "file_no"])
    columns = ["book", "pos", "part_no", "part_title", "path"]
    hit = in_parts.select(*columns).unionByName(loose.select(*columns)).groupBy("book", "pos", "part_no", "part_title").agg(F.min("path").alias("path"))
    toc = hit.select("book", F.lit(1).alias("tier"), F.struct(F.col("pos").cast("long").alias("a"), key.alias("k")).alias("at"), "path", F.concat(F.lit("Part "), "part_no", F.lit(". "), "part_title").alias("part_label"))
    kept = known.filter(~any_glob(C.file_name(F.col("path")), F.coalesce("exclude", F.array(*map(F.lit, DEFAULT_EXCLUDE))))).select("book", "path")
    named = C.by_convention(kept)
    convention = named.select("book", F.lit(2).alias("tier"), F.struct((F.col("section") * 1000 + F.col("_rank")).cast("long").alias("a"), F.col("_key").alias("k")).alias("at"), "path", F.col("label").alias("part_label"))
    has_parts = kept.filter(F.col("path").rlike("^Part_[IVX]+_")).select("book").distinct()
    natural = kept.select("book", F.lit(3).alias("tier"), F.struct(F.lit(0).cast("long").alias("a"), key.alias("k")).alias("at"), "path", none)
    tiers = explicit.unionByName(toc).unionByName(convention.join(has_parts, "book", "left_semi")).unionByName(natural)
    tiers = written(tiers)
    lowest = tiers.groupBy("book").agg(F.min("tier").alias("tier"))
    chosen = tiers.join(lowest, ["book", "tier"])
    pos = F.row_number().over(Window.partitionBy("book").orderBy("at", "path"))
    return chosen.select("book", F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1).alias("tier"), pos.alias("pos_out"), "path", "part_label")
