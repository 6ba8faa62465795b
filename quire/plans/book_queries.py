"""Queries that build books from chapters, with links between chapters, images, split chapters and diagrams, and their SQL.

The books are the sources; chapters link to the next one of their book, to a file that isn't there and outside, and hold an image
of the book and a missing one.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bookbuild as B
from ..session import written
from .views import v_chapters, with_views

BOOK = "(src\\d+)\\.md$"
COLORS = ("blue", "Teal")


def v_parts(spark, d):
    """(books, chapters, images)."""
    c = v_chapters(spark, d).withColumn("book", F.regexp_extract("path", BOOK, 1))
    w = F.regexp_replace("title", "[^A-Za-z]", "")
    c = c.withColumn("w", F.when(w == "", "x").otherwise(w)).withColumn("up", F.when(F.col("path").contains("/"), "../").otherwise(""))
    after = F.coalesce(F.lead("path").over(Window.partitionBy("book").orderBy("pos")), F.lit("gone.md"))
    n = F.col("pos").cast("string")
    body = F.concat(
        F.lit("# Topic "), (F.col("pos") % 7).cast("string"), F.lit(" "), "w", F.lit("\n\n[see]("), "up", after, F.lit("#part) [no](nowhere/y.md) [out](https://x.org/a.md) ![i]("), "up", F.lit("img/"), (F.col("pos") % 5).cast("string"), F.lit(".png) ![m](img/none"), n, F.lit(".png)\n"),
        F.when(F.col("pos") % 11 == 0, F.lit("\n```mermaid\nA\n```\n")).otherwise(""), F.when(F.col("pos") % 3 == 0, F.concat(F.lit("\n## Part "), "w", F.lit("\n\nmore\n"))).otherwise(""),
    )
    override = F.when(F.col("pos") % 13 == 0, F.concat(F.lit("own-"), n))
    chapters = c.select("book", "pos", "path", "part_label", body.alias("text"), (F.col("pos") % 2 == 0).alias("split"), F.lit(None).cast("string").alias("tip"), override.alias("override"))
    names = c.select("book").distinct()
    color = F.element_at(F.array(*map(F.lit, COLORS)), (F.length("book") % 2 + 1).cast("int"))
    books = names.select("book", F.concat(F.lit("Book <"), "book", F.lit(">")).alias("title"), F.lit("en").alias("language"), color.alias("color"), F.lit("p { margin: 0 }\n").alias("css"))
    images = names.select("book", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("book", F.concat(F.lit("img/"), F.col("i").cast("string"), F.lit(".png")).alias("path"), F.base64(F.encode(F.concat("book", F.col("i").cast("string")), "UTF-8")).alias("base64"))
    return books, chapters, images


def sk1(spark, d):
    """Whole books: contents, sections, links, images and the shell around them."""
    pages, _ = B.built(*v_parts(spark, d))
    return pages.select("book", "file", "n_chapters", "n_sections", "needs_diagrams", F.md5("html").alias("digest"))


def x12(spark, d):
    """Images that chapters name and books don't have."""
    _, chapters, images = v_parts(spark, d)
    _, missing = B.linked(written(B.pieces(chapters)), images)
    return missing.select("book", "pos", "piece", "path", "src")


def f15(spark, d):
    """References of chapters, and the file that each means."""
    _, chapters, _ = v_parts(spark, d)
    return B.references(B.pieces(chapters))


def a20(spark, d):
    """Whether a book has a diagram that isn't drawn: every other one is marked as drawn."""
    _, chapters, _ = v_parts(spark, d)
    drawn = F.when(F.col("pos") % 2 == 0, F.replace("html", F.lit('class="mermaid"'), F.lit('class="mermaid" data-prerendered="true"'))).otherwise(F.col("html"))
    return B.pieces(chapters).groupBy("book").agg(F.bool_or(B.needs_script(drawn)).alias("needs_cdn"))


PARTS = f"""c AS (SELECT pos, path, part_label, regexp_extract(path, '{BOOK}', 1) AS book, CASE WHEN regexp_replace(title, '[^A-Za-z]', '', 'g') = '' THEN 'x' ELSE regexp_replace(title, '[^A-Za-z]', '', 'g') END AS w, CASE WHEN contains(path, '/') THEN '../' ELSE '' END AS up FROM v_chapters),
 n AS (SELECT *, coalesce(lead(path) OVER (PARTITION BY book ORDER BY pos), 'gone.md') AS nxt, 'Topic ' || (pos % 7) || ' ' || w AS t, pos % 3 = 0 AND pos % 2 = 0 AS cut FROM c),
 pc AS (SELECT book, pos, 0 AS piece, path, CASE WHEN cut THEN t ELSE part_label END AS label, t AS title, CASE WHEN pos % 13 = 0 THEN 'own-' || pos ELSE lower(replace(t, ' ', '-')) END AS base FROM n
  UNION ALL SELECT book, pos, 1, path, t, 'Part ' || w, CASE WHEN pos % 13 = 0 THEN 'own-' || pos ELSE 'part-' || lower(w) END FROM n WHERE cut),
 sd AS (SELECT *, base || CASE WHEN row_number() OVER o = 1 THEN '' ELSE '-' || row_number() OVER o END AS sid FROM pc WINDOW o AS (PARTITION BY book, base ORDER BY pos, piece)),
 ids AS (SELECT book, path, arg_min(sid, (pos, piece)) AS sid FROM sd GROUP BY ALL)"""
FOLDER = "regexp_replace(path, '/?[^/]*$', '')"
ALL = {
    "a20_any_flag": (a20, with_views(f"WITH {PARTS} SELECT book, bool_or(pos % 11 = 0 AND pos % 2 = 1) AS needs_cdn FROM n GROUP BY book", "v_chapters")),
    "sk1_book_html": (sk1, with_views(f"""WITH {PARTS},
 h AS (SELECT sd.*, CASE WHEN piece = 1 THEN '<h2 id="part-' || lower(w) || '">Part ' || w || '</h2>' || chr(10) || '<p>more</p>' ELSE
  '<h2 id="topic-' || (n.pos % 7) || '-' || lower(w) || '">' || t || '</h2>' || chr(10) || '<p><a href="' || coalesce('#' || ids.sid, up || nxt || '#part') || '">see</a> <a href="nowhere/y.md">no</a> <a href="https://x.org/a.md">out</a> <img alt="i" src="data:image/png;base64,' || to_base64(encode(n.book || (n.pos % 5))) || '" /> <img alt="m" src="img/none' || n.pos || '.png" /></p>'
  || CASE WHEN n.pos % 11 = 0 THEN chr(10) || '<div class="mermaid" data-lf-preserve="mermaid">A' || chr(10) || '</div>' ELSE '' END || CASE WHEN n.pos % 3 = 0 AND NOT cut THEN chr(10) || '<h3 id="part-' || lower(w) || '">Part ' || w || '</h3>' || chr(10) || '<p>more</p>' ELSE '' END END AS html
  FROM sd JOIN n USING (book, pos) LEFT JOIN ids ON ids.book = sd.book AND ids.path = n.nxt),
 l AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY book ORDER BY pos, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
 g AS (SELECT book, string_agg(CASE WHEN label IS NOT NULL AND label IS DISTINCT FROM before THEN '<a class="part-heading">' || label || '</a>' || chr(10) ELSE '' END || '<a class="chapter toc-link" href="#' || sid || '">' || title || '</a>', chr(10) ORDER BY pos, piece) AS toc,
  string_agg('<section class="chapter-section" id="' || sid || '" data-section-title="' || title || '">' || chr(10) || html || chr(10) || '</section>', chr(10) ORDER BY pos, piece) AS body, count(DISTINCT pos) AS n_chapters, count(*) AS n_sections, bool_or(pos % 11 = 0 AND piece = 0) AS live FROM l GROUP BY book)
 SELECT book, 'book-' || book || '.html' AS file, n_chapters, n_sections, live AS needs_diagrams, md5('<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>Book &lt;' || book || '&gt;</title>' || chr(10) || CASE WHEN live THEN '<script src="{B.DIAGRAM_SCRIPT}"></script>' || chr(10) ELSE '' END
  || '<style>' || chr(10) || CASE WHEN length(book) % 2 = 0 THEN '/* ── color theme: blue ── */' || chr(10) || ':root {{ --primary: #1565c0; --primary-light: #1e88e5; --accent: #00897b; }}' ELSE '/* ── color theme: teal ── */' || chr(10) || ':root {{ --primary: #00695c; --primary-light: #00897b; --accent: #5e35b1; }}' END || chr(10) || chr(10) || 'p {{ margin: 0 }}'
  || chr(10) || '</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<nav id="sidebar"><div id="toc">' || chr(10) || toc || chr(10) || '</div></nav>' || chr(10) || '<main id="main">' || chr(10) || body || chr(10) || '</main>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)) AS digest FROM g""", "v_chapters")),
    "x12_missing_images": (x12, with_views(f"WITH {PARTS} SELECT book, pos, 0 AS piece, CASE WHEN {FOLDER} = '' THEN '' ELSE {FOLDER} || '/' END || 'img/none' || pos || '.png' AS path, 'img/none' || pos || '.png' AS src FROM n", "v_chapters")),
    "f15_reference_classes": (f15, with_views(f"""WITH {PARTS}, r AS (SELECT n.*, unnest([0, 1, 2, 3, 4]) AS k FROM n) SELECT book, pos, 0 AS piece, k::INT AS k, CASE WHEN k < 3 THEN 'href' ELSE 'src' END AS attribute,
 CASE k WHEN 0 THEN up || nxt || '#part' WHEN 1 THEN 'nowhere/y.md' WHEN 2 THEN 'https://x.org/a.md' WHEN 3 THEN up || 'img/' || (pos % 5) || '.png' ELSE 'img/none' || pos || '.png' END AS value,
 CASE k WHEN 0 THEN nxt WHEN 1 THEN CASE WHEN {FOLDER} = '' THEN '' ELSE {FOLDER} || '/' END || 'nowhere/y.md' WHEN 3 THEN 'img/' || (pos % 5) || '.png' WHEN 4 THEN CASE WHEN {FOLDER} = '' THEN '' ELSE {FOLDER} || '/' END || 'img/none' || pos || '.png' END AS target FROM r""", "v_chapters")),
}
