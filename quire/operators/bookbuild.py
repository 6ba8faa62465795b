"""Books as single HTML pages, in two passes: the first renders pieces and settles their ids, the second rewrites references.

References go forward as well as back, so none can be rewritten before all ids are known. The second pass takes the attributes out
of the HTML, resolves them as rows against ids and images, and puts them back between the pieces of text they came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import rendered
from ..functions.text import demote_headings, first_h1, html_escape, nfc, ordered_concat, raw_h1, slug, strip
from ..functions.theme import theme_css
from ..session import written
from .corpus import normalised_path, numbered, part_headings
from .splitting import split_pieces

REFERENCE = r'(?:href|src)="[^"]+"'
#: References that name no file of the book, by attribute.
OUTSIDE = {"href": "^(https?://|data:|#|mailto:)", "src": "^(https?://|data:|file://|#)"}
# Kinds of images by ending.
KINDS = {"png": "image/png", "svg": "image/svg+xml", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


def data_uri(path: Column, base64: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), ending), F.lit("application/octet-stream"))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), base64)


def pieces(chapters: DataFrame, level: int = 2) -> DataFrame:
    """(book, pos, piece, path, label, sid, title, html): the first pass over chapters (book, pos, path, part_label, text, split, tip, override).

    A chapter with `split` is cut at headings of a level; its pieces stand under its own title. An id is the override, else the
    slug of the title, else that of the file's name; the n-th of a book with the same id gets -n. A null text is empty.
    """
    rows = chapters.withColumn("key", F.struct("book", "pos")).withColumn("text", F.coalesce("text", F.lit("")))
    cut = split_pieces(rows.filter("split"), "key", "text", level).select("key", F.col("piece_ix").cast("int").alias("piece"), "md")
    cut = cut.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("key")) > 1)
    whole = rows.filter("not coalesce(split, false)").select("key", F.lit(0).alias("piece"), F.col("text").alias("md"), F.lit(False).alias("many"))
    both = cut.unionByName(whole).join(rows.select("key", "path", "part_label", "text", "tip", "override"), "key")
    label = F.when(F.col("many"), F.coalesce(raw_h1(F.col("text")), F.col("part_label"))).otherwise(F.col("part_label"))
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    made = both.select("key.book", "key.pos", "piece", "path", label.alias("label"), "override", stem.alias("stem"), rendered("md", "tip").alias("html"))
    made = written(made)
    h1 = F.nullif(first_h1(F.col("html")), F.lit(""))
    named = made.select("*", F.coalesce(h1, "stem").alias("title")).withColumn("base", F.coalesce(F.nullif("override", F.lit("")), slug(F.col("title"))))
    counted = numbered(written(named), ["book", "base"], ["pos", "piece"], "n")
    sid = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string")))
    return counted.select("book", "pos", "piece", "path", "label", sid.alias("sid"), "title", "html")


def references(made: DataFrame) -> DataFrame:
    """(book, pos, piece, k, attribute, value, target): the references of pieces in order; target is the file of the book that is meant, if any."""
    hits = made.select("book", "pos", "piece", F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.posexplode(F.regexp_extract_all("html", F.lit(REFERENCE), F.lit(0))).alias("k", "hit"))
    rows = hits.select("book", "pos", "piece", "k", "folder", F.regexp_extract("hit", '^(href|src)="', 1).alias("attribute"), F.regexp_extract("hit", '"([^"]+)"', 1).alias("value"))
    file = F.when(F.col("attribute") == "href", F.regexp_replace("value", "#.*$", "")).otherwise(F.col("value"))
    inside = F.when(F.col("attribute") == "href", ~F.col("value").rlike(OUTSIDE["href"]) & file.endswith(".md")).otherwise(~F.col("value").rlike(OUTSIDE["src"]))
    return rows.withColumn("target", F.when(inside, nfc(normalised_path(F.col("folder"), file)))).drop("folder")


def linked(made: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces with references rewritten, references to images that don't exist): the second pass.

    A link to a chapter becomes the anchor of its first piece, an image (book, path, base64) becomes data. All else stays as it is.
    """
    refs = written(references(made))
    ids = made.groupBy("book", F.col("path").alias("target")).agg(F.min_by("sid", F.struct("pos", "piece")).alias("sid"))
    href = refs.filter("attribute = 'href'").join(ids, ["book", "target"], "left").withColumn("value", F.coalesce(F.concat(F.lit("#"), "sid"), "value")).drop("sid")
    held = images.select("book", F.col("path").alias("target"), data_uri(F.col("path"), F.col("base64")).alias("uri"))
    src = written(refs.filter("attribute = 'src'").join(held, ["book", "target"], "left"))
    missing = src.filter("target is not null and uri is null").select("book", "pos", "piece", F.col("target").alias("path"), F.col("value").alias("src"))
    src = src.withColumn("value", F.coalesce("uri", "value")).drop("uri")
    put = F.concat("attribute", F.lit('="'), "value", F.lit('"'))
    ordered = href.unionByName(src).groupBy("book", "pos", "piece").agg(F.array_sort(F.collect_list(F.struct("k", put.alias("put")))).alias("refs"))
    both = made.join(ordered, ["book", "pos", "piece"], "left")
    gaps = F.split("html", REFERENCE, -1)
    back = F.array_join(F.zip_with(gaps, F.concat(F.transform("refs", lambda r: r["put"]), F.array(F.lit(""))), lambda g, p: F.concat(g, p)), "")
    return both.withColumn("html", F.when(F.col("refs").isNull(), F.col("html")).otherwise(back)).drop("refs"), missing


def shell(title: Column, language: Column, css: Column, toc: Column, body: Column, diagrams: Column, script: str) -> Column:
    """The page around a book's sections: its own head, a list of contents and the sections."""
    live = F.when(diagrams, F.lit(f'<script src="{script}"></script>\n')).otherwise(F.lit(""))
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="'), language, F.lit('">\n<head>\n<meta charset="utf-8">\n<title>'), html_escape(title), F.lit("</title>\n"), live, F.lit("<style>\n"), css,
        F.lit('\n</style>\n</head>\n<body>\n<nav id="sidebar"><div id="toc">\n'), toc, F.lit('\n</div></nav>\n<main id="main">\n'), body, F.lit("\n</main>\n</body>\n</html>\n"),
    )


def needs_script(html: Column) -> Column:
    """Whether a diagram isn't drawn yet."""
    return html.rlike(r'<div class="mermaid"(?![^>]*data-prerendered="true")')


DIAGRAM_SCRIPT = "mermaid.min.js"


def built(books: DataFrame, chapters: DataFrame, images: DataFrame, level: int = 2, script: str = DIAGRAM_SCRIPT) -> tuple[DataFrame, DataFrame]:
    """(books as pages, missing images): books (book, title, language, color, css) with their chapters and images.

    Pages are (book, file, html, n_chapters, n_sections, needs_diagrams). A diagram that isn't drawn in advance needs a script. A
    book without chapters has no page; a title that is missing is the book's name, a missing language is ko.
    """
    made, missing = linked(written(pieces(chapters, level)), images)
    headed = part_headings(made.withColumnRenamed("label", "part_label").withColumn("at", F.struct("pos", "piece")), ["book"], "at", False)
    part = F.when(F.col("heading").isNotNull() & (F.col("heading") != ""), F.concat(F.lit('<a class="part-heading">'), html_escape(F.col("heading")), F.lit("</a>\n"))).otherwise(F.lit(""))
    entry = F.concat(part, F.lit('<a class="chapter toc-link" href="#'), "sid", F.lit('">'), html_escape(F.col("title")), F.lit("</a>"))
    section = F.concat(F.lit('<section class="chapter-section" id="'), "sid", F.lit('" data-section-title="'), html_escape(F.col("title")), F.lit('">\n'), demote_headings(F.col("html")), F.lit("\n</section>"))
    order = [F.col("pos"), F.col("piece")]
    whole = headed.groupBy("book").agg(ordered_concat(entry, order, "\n").alias("toc"), ordered_concat(section, order, "\n").alias("body"), F.count_distinct("pos").alias("n_chapters"), F.count(F.lit(1)).alias("n_sections"), F.bool_or(needs_script(F.col("html"))).alias("needs_diagrams"))
    named = whole.join(books.withColumnRenamed("title", "_title"), "book").withColumn("title", F.coalesce(F.nullif("_title", F.lit("")), F.col("book").cast("string")))
    css = F.concat_ws("\n\n", F.when(F.col("color").isNotNull(), theme_css(F.col("color"))), F.nullif(strip(F.col("css")), F.lit("")))
    page = shell(F.col("title"), F.coalesce("language", F.lit("ko")), css, F.col("toc"), F.col("body"), F.col("needs_diagrams"), script)
    return named.select("book", F.concat(slug(F.col("title")), F.lit(".html")).alias("file"), page.alias("html"), "n_chapters", "n_sections", "needs_diagrams"), missing
