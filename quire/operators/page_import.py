"""Positioned words as Markdown: the page operators composed, from words to texts of pages and documents.

A page is cut into what stands before its table, the table, and what stands after; the first and the last are read column by
column. What is calibrated over a document (sizes, headings, repeated lines) is joined back to pages as small tables.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import pages as G
from ..functions.text import ordered_concat
from ..session import written
from . import layout as L
from .corpus import strip_repeated_lines
from .paragraphs import CODE, CODE_END, HEADING, repair

WORD = ["doc_id", "page", "t", "text", "x0", "x1", "top", "bottom", "size", "fontname"]
PLACE = {"x0", "x1", "top", "bottom", "size"}
_MONO = re.compile("courier|consolas|mono", re.IGNORECASE | re.ASCII)


def image_words(images: DataFrame) -> DataFrame:
    """Images (doc_id, page, n, path, x0, x1, top, bottom) as words without size and font: references that stand in the flow of text."""
    return images.select(
        "doc_id", "page", (F.lit(1 << 24) + F.col("n")).cast("int").alias("t"), F.concat(F.lit("![]("), "path", F.lit(")")).alias("text"),
        *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")], F.lit(None).cast("double").alias("size"), F.lit(None).cast("string").alias("fontname"),
    )


def in_rows(words: DataFrame) -> DataFrame:
    return L.anchored_rows(words.select(*WORD)).withColumnRenamed("row_ix", "row").select(*WORD, "row")


def in_regions(words: DataFrame) -> DataFrame:
    """Words with `region`: 0 before the page's table, 1 in it, 2 after; 0 where there is none."""
    tables = L.table_runs(words)
    both = words.join(tables, L.KEYS, "left")
    return both.withColumn("region", F.when(F.col("start_row").isNull() | (F.col("row") < F.col("start_row")), 0).when(F.col("row") < F.col("end_row"), 1).otherwise(2)).drop("start_row", "end_row")


def gathered(words: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, words): the words of each page, and its images as words, in one row; those without a page go."""
    flagged = words.select(*WORD, F.lit(False).alias("image"))
    if images is not None:
        flagged = flagged.unionByName(image_words(images).withColumn("image", F.lit(True)))
    # doubles whatever the caller has, as the functions over pages count in them
    fields = [F.col(c).cast("double").alias(c) if c in PLACE else F.col(c) for c in flagged.columns if c not in L.KEYS]
    return flagged.filter("doc_id is not null and page is not null").groupBy(*L.KEYS).agg(F.collect_list(F.struct(*fields)).alias("words"))


@lru_cache(maxsize=4096)
def _mono(font: str | None) -> bool:
    return font is not None and _MONO.search(font) is not None


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """(words, images) of each page of a batch, as tuples of functions.pages."""
    column = batch.column("words")
    values = column.flatten()
    parts = dict(zip([f.name for f in values.type], values.flatten()))
    x0, x1, top, bottom, size = ([math.nan if v is None else v for v in parts[c].to_pylist()] for c in ("x0", "x1", "top", "bottom", "size"))
    x0 = [0.0 if v != v else v for v in x0]
    x1 = [a if v != v else v for a, v in zip(x0, x1)]
    t, text = [-1 if v is None else v for v in parts["t"].to_pylist()], [G.NULL if v is None else v for v in parts["text"].to_pylist()]
    mono = [_mono(v) for v in parts["fontname"].to_pylist()]
    words, image = list(zip(x0, t, text, x1, top, bottom, size, mono)), parts["image"].to_pylist()
    placed = [known and v is not None for known, v in zip(parts["top"].is_valid().to_pylist(), image)]
    at = 0
    for n in column.value_lengths().to_pylist():
        n = n or 0
        here = range(at, at + n)
        yield [words[i] for i in here if placed[i] and not image[i]], [words[i] for i in here if placed[i] and image[i]]
        at += n


def _clean_rows(words: list, images: list, height: float | None) -> list:
    return G.rows_of(G.cleaned(words, height) + images)


def _mapped(pages: DataFrame, one: Callable[..., list[tuple]], made: str, *given: str) -> DataFrame:
    """Rows (doc_id, page, made) that one(words, images, values of the columns given) makes of each page."""
    kinds = dict(pages.dtypes)
    schema = f"doc_id {kinds['doc_id']}, page {kinds['page']}, {made}"
    names = StructType.fromDDL(made).names
    types = to_arrow_schema(StructType.fromDDL(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ix, rows = [], []
            for i, ((words, images), *values) in enumerate(zip(_unpacked(b), *[b.column(c).to_pylist() for c in given])):
                found = one(words, images, *values)
                ix += [i] * len(found)
                rows += found
            keys = b.select(L.KEYS).take(pa.array(ix, pa.int64()))
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*keys.columns, *[pa.array(c, types.field(n).type) for c, n in zip(columns, names)]], [*L.KEYS, *names])

    return pages.select(*L.KEYS, "words", *given).mapInArrow(run, schema)


def region_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, page, region, col, text) of gathered pages: tables as pipes, what stands before and after them by columns."""

    def one(words: list, images: list) -> list[tuple]:
        return G.region_texts(G.rows_of(words + images), CODE, CODE_END)

    return _mapped(pages, one, "region int, col int, text string")


def heading_rows(pages: DataFrame) -> DataFrame:
    """(doc_id, page, headings) of gathered pages with their height: rows that are headings; documents with too many of them get none.

    Sizes are counted and candidates found page by page; a document's body and headings are calibrated over all its pages.
    """

    def one(words: list, images: list, height: float | None) -> list[tuple]:
        rows = _clean_rows(words, images, height)
        sizes = [dict(zip(("bucket", "n", "t"), s)) for s in G.size_counts(rows)]
        return [(len(rows), sizes, [dict(zip(("row", "size"), c)) for c in G.heading_candidates(rows)])]

    stats = written(_mapped(pages, one, "n_rows long, sizes array<struct<bucket:double,n:long,t:int>>, found array<struct<row:int,size:double>>", "height"))
    counted = stats.select(*L.KEYS, F.explode("sizes").alias("s")).groupBy("doc_id", "s.bucket").agg(F.sum("s.n").alias("n"), F.min(F.struct("page", "s.t")).alias("first"))
    bodies = L.counted_body(counted).filter("body_size is not null")
    listed = L.counted_headings(counted, bodies).groupBy("doc_id").agg(F.collect_set("bucket").alias("sizes"))
    found = stats.select(*L.KEYS, F.explode("found").alias("c")).select(*L.KEYS, "c.row", "c.size")
    heads = written(found.join(bodies, "doc_id").join(listed, "doc_id", "left").filter(L.stands_out(F.col("size"))).select(*L.KEYS, "row"))
    sane = L.counted_sanity(heads, stats.groupBy("doc_id").agg(F.sum("n_rows").alias("n_rows"))).filter("sane and n_headings > 0").select("doc_id")
    return heads.join(sane, "doc_id").groupBy(*L.KEYS).agg(F.array_sort(F.collect_list("row")).alias("headings"))


def page_texts(pages: DataFrame, words: DataFrame, images: DataFrame | None = None, headings: bool = True) -> DataFrame:
    """(doc_id, page, text) of every page (doc_id, page, height), empty where nothing stands.

    words have the columns WORD, or are gathered already. Words with control characters and lone numbers in the margins go; images
    come as references. Headings and code stand behind and between marks, which document_texts turns into Markdown. Words are moved
    once, to their page; what is calibrated over a document moves by rows of pages.
    """
    if "words" not in words.columns:
        words = gathered(words, images)
        words = written(words) if headings else words
    heights = pages.select(*L.KEYS, F.col("height").cast("double").alias("height"))
    sized = words.join(heights.hint("shuffle_hash"), L.KEYS)
    if headings:
        found = heading_rows(words.join(heights.hint("shuffle_hash"), L.KEYS, "left"))
        sized = sized.join(found.hint("shuffle_hash"), L.KEYS, "left")
    else:
        sized = sized.withColumn("headings", F.lit(None).cast("array<int>"))

    def one(words: list, images: list, height: float | None, rows_: list[int] | None) -> list[tuple]:
        rows = _clean_rows(words, images, height)
        G.marked(rows, rows_ or [], HEADING)
        return [("\n\n".join([text for _, _, text in G.region_texts(rows, CODE, CODE_END) if text]),)]

    made = _mapped(sized, one, "text string", "height", "headings")
    return made.unionByName(pages.select(*L.KEYS).join(words.select(*L.KEYS), L.KEYS, "left_anti").withColumn("text", F.lit("")))


def document_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, body) of pages (doc_id, page, text): repeated lines go, wrapped lines are joined across pages, marks become Markdown."""
    lines = texts.select(F.col("doc_id").alias("doc"), "page", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    stripped = written(strip_repeated_lines(lines))
    whole = stripped.groupBy("doc").agg(ordered_concat(F.col("text"), [F.col("page")], "\n\n").alias("text"))
    again = whole.select("doc", F.lit(0).alias("page"), F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return repair(again).select(F.col("doc").alias("doc_id"), F.col("text").alias("body"))


def imported(pages: DataFrame, words: DataFrame, images: DataFrame | None = None, name: Column | None = None, headings: bool = True) -> DataFrame:
    """(doc_id, path, kind, content): each document as a Markdown file, and the configuration of its book.

    name is a column over doc_id (its text by default). A body with headings is to be split at them.
    """
    made = document_texts(written(page_texts(pages, words, images, headings)))
    named = made.withColumn("name", F.col("doc_id").cast("string") if name is None else name)
    split = F.col("body").rlike(r"(?md)^##\s+\S")
    config = F.concat(F.lit("language: en\n"), F.when(split, F.concat(F.lit("split:\n  files:\n  - "), "name", F.lit(".md\n  heading_level: 2\n"))).otherwise(F.lit("")))
    files = named.select("doc_id", F.concat("name", F.lit(".md")).alias("path"), F.lit("chapter").alias("kind"), F.concat(F.lit("# "), "name", F.lit("\n\n"), "body", F.lit("\n")).alias("content"))
    return files.unionByName(named.select("doc_id", F.lit("book.yaml").alias("path"), F.lit("config").alias("kind"), config.alias("content")))
