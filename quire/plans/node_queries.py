"""Queries on node tables of books: images, diagrams and sections as an editor lists them, saved edits, exported sections.

A book is made of each document: six lines a section, as a heading, a paragraph, a figure, a paragraph with an image, a framed and
a bare diagram.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions.text import ordered_concat
from ..operators import nodes as N
from ..session import written
from .views import v_chapters, v_lines, with_views

#: A picture for the images that come as data.
PIXEL = "R0lGODlhAQABAAAAACwAAAAAAQABAAA="


def _lines(spark, d):
    line = F.trim(F.regexp_replace(F.regexp_replace("line", "[^\\p{L}\\p{N} ]", ""), " +", " "))
    return v_lines(spark, d).select("page", "ln", line.alias("l"))


def v_book(spark, d):
    """(page, html)."""
    ln, line, n = F.col("ln"), F.col("l"), F.col("ln").cast("string")
    src = F.when(ln % 4 == 2, F.lit(f"data:image/gif;base64,{PIXEL}")).otherwise(F.concat(F.lit("i"), n, F.lit(".png")))
    k = ln % 6
    part = (
        F.when(k == 0, F.concat(F.when(ln > 0, "</section>\n").otherwise(""), F.lit('<section id="s'), n, F.lit('"><h2>'), n, F.lit(". "), line, F.lit("</h2>")))
        .when(k == 1, F.concat(F.lit("<p>"), line, F.lit(" &amp; more</p>")))
        .when(k == 2, F.concat(F.lit('<figure><img src="'), src, F.lit('" alt="Page '), n, F.lit('"/><figcaption>'), line, F.lit("</figcaption></figure>")))
        .when(k == 3, F.concat(F.lit('<p>x <img alt="'), line, F.lit('" src="'), n, F.lit('.png"/></p>')))
        .when(k == 4, F.concat(F.lit('<div class="my-8"><h4>'), line, F.lit('</h4><div class="mermaid">Graph '), n, F.lit("</div></div>")))
        .otherwise(F.concat(F.lit('<div class="mermaid">'), line, F.lit("</div>")))
    )
    body = ordered_concat(part, [ln], "\n")
    html = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en"><head><title>T</title><script>a < b && c</script></head><body><!-- note -->'), body, F.lit("</section></body></html>"))
    return _lines(spark, d).groupBy("page").agg(html.alias("html"))


def _nodes(spark, d):
    return written(M.html_nodes(v_book(spark, d), "page", "html"))


def sc14(spark, d):
    return N.images(_nodes(spark, d), "page").select("page", "n", F.md5("src").alias("src"), "alt", "caption", "section", "page_no")


def sc15(spark, d):
    return N.diagrams(_nodes(spark, d), "page").select("page", "n", "title", "kind", "code", "section")


def sc13(spark, d):
    return N.sections(_nodes(spark, d), "page").select("page", "n", "id", "title", "word_count", "image_count", "diagram_count")


def f19(spark, d):
    """The elements that each section's list shows."""
    nodes = _nodes(spark, d)
    return N.visuals_of(N.sections(nodes, "page"), N.elements(nodes, "page"), "page")


def w15(spark, d):
    """Images and diagrams in one order."""
    return N.elements(_nodes(spark, d), "page")


def _edits(nodes):
    img = N.images(nodes, "page").select("page", F.lit("image").alias("kind"), "n", F.when(F.col("n") % 5 == 0, "delete").when(F.col("n") % 3 == 1, "replace").alias("op"))
    dgm = N.diagrams(nodes, "page").select("page", F.lit("diagram").alias("kind"), "n", F.when(F.col("n") % 4 == 1, "delete").alias("op"))
    return img.unionByName(dgm).filter("op is not null").withColumn("value", F.concat(F.lit('new"&'), F.col("n").cast("string"), F.lit(".png")))


def sk12(spark, d):
    """Books after images and diagrams were deleted and images replaced."""
    nodes = _nodes(spark, d)
    return N.html_of(N.saved(nodes, _edits(nodes), "page"), ["page"]).select("page", F.md5("html").alias("digest"))


def sk10(spark, d):
    """Sections as Markdown files, images as files beside them."""
    return N.exported(_nodes(spark, d), "page").select("page", "path", "kind", F.md5("content").alias("digest"))


def sk10_names(spark, d):
    """Names of exported chapters, by order in the book and id."""
    w = Window.partitionBy("book").orderBy("pos")
    c = v_chapters(spark, d).withColumn("book", F.regexp_extract("path", "(src\\d+)\\.md$", 1))
    return c.select("book", "pos", F.format_string("%03d_s%d.md", F.row_number().over(w), F.col("pos")).alias("file"))


LINES = "bl AS (SELECT page, ln, trim(regexp_replace(regexp_replace(line, '[^\\p{L}\\p{N} ]', '', 'g'), ' +', ' ', 'g')) AS l FROM v_lines)"
DATA = f"data:image/gif;base64,{PIXEL}"
NUMBERED = f"""{LINES}, hd AS (SELECT page, ln, l AS hl FROM bl WHERE ln % 6 = 0), b AS (SELECT bl.page, bl.ln, l, bl.ln % 6 AS k, (bl.ln - bl.ln % 6) || '. ' || hl AS head, CASE WHEN bl.ln % 6 = 2 AND bl.ln % 4 = 2 THEN '{DATA}' WHEN bl.ln % 6 = 2 THEN 'i' || bl.ln || '.png' ELSE bl.ln || '.png' END AS src
  FROM bl JOIN hd ON hd.page = bl.page AND hd.ln = bl.ln - bl.ln % 6),
 im AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ln) AS n, CASE k WHEN 2 THEN 'Page ' || ln ELSE l END AS alt, CASE k WHEN 2 THEN l ELSE '' END AS caption FROM b WHERE k IN (2, 3)),
 ip AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(alt, '(?i)page\\s+(\\d+)', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(caption, '(?i)page\\s+(\\d+)', 1), '') AS BIGINT)) AS pg FROM im),
 dg AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ln) AS n FROM b WHERE k IN (4, 5)),
 dk AS (SELECT *, CASE k WHEN 4 THEN l ELSE '{N.DIAGRAM_TITLE}' || n END AS title, CASE k WHEN 4 THEN 'graph' ELSE CASE WHEN l = '' THEN 'diagram' ELSE lower(split_part(l, ' ', 1)) END END AS kind, CASE k WHEN 4 THEN 'Graph ' || ln ELSE l END AS code FROM dg),
 el AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ln) AS display_index FROM (SELECT page, ln, 'image' AS kind, n, substr(CASE WHEN alt <> '' THEN alt WHEN caption <> '' THEN caption ELSE '설명 없음' END, 1, 50) AS title, head AS section, CASE WHEN coalesce(pg, 0) <> 0 THEN 'p.' || pg ELSE '-' END AS extra FROM ip
   UNION ALL SELECT page, ln, 'diagram', n, substr(title, 1, 50), head, kind FROM dk)),
 w AS (SELECT *, len(regexp_extract_all(l, '\\S+')) AS words FROM b)"""
SAVED = f"""WITH {NUMBERED}, x AS (SELECT b.*, im.n AS i, dg.n AS g FROM b LEFT JOIN im ON im.page = b.page AND im.ln = b.ln LEFT JOIN dg ON dg.page = b.page AND dg.ln = b.ln),
 y AS (SELECT *, CASE WHEN i % 3 = 1 THEN 'new&quot;&amp;' || i || '.png' ELSE src END AS s FROM x),
 z AS (SELECT page, ln, CASE k WHEN 0 THEN CASE WHEN ln > 0 THEN '</section>' || chr(10) ELSE '' END || '<section id="s' || ln || '"><h2>' || ln || '. ' || l || '</h2>' WHEN 1 THEN '<p>' || l || ' &amp; more</p>'
  WHEN 2 THEN CASE WHEN i % 5 = 0 THEN '' ELSE '<figure><img src="' || s || '" alt="Page ' || ln || '"/><figcaption>' || l || '</figcaption></figure>' END
  WHEN 3 THEN CASE WHEN i % 5 = 0 THEN '<p>x </p>' ELSE '<p>x <img alt="' || l || '" src="' || s || '"/></p>' END
  WHEN 4 THEN CASE WHEN g % 4 = 1 THEN '' ELSE '<div class="my-8"><h4>' || l || '</h4><div class="mermaid">Graph ' || ln || '</div></div>' END ELSE CASE WHEN g % 4 = 1 THEN '' ELSE '<div class="mermaid">' || l || '</div>' END END AS part FROM y)
 SELECT page, md5('<!DOCTYPE html>' || chr(10) || '<html lang="en"><head><title>T</title><script>a < b && c</script></head><body><!-- note -->' || string_agg(part, chr(10) ORDER BY ln) || '</section></body></html>') AS digest FROM z GROUP BY page"""
# a section's Markdown: paragraphs, figures and diagrams with blank lines between; what is empty leaves no line
EXPORT = f"""WITH {NUMBERED}, di AS (SELECT page, ln, row_number() OVER (PARTITION BY page ORDER BY ln) AS j FROM b WHERE k = 2 AND ln % 4 = 2),
 p AS (SELECT b.page, b.ln - k AS s, b.ln, head, CASE k WHEN 1 THEN trim(l || ' & more') WHEN 2 THEN '![Page ' || b.ln || '](' || CASE WHEN j IS NULL THEN src ELSE 'images/s' || (b.ln - k) || '-' || j || '.gif' END || ')' || CASE WHEN l = '' THEN '' ELSE chr(10) || chr(10) || l END
   WHEN 3 THEN 'x ![' || l || '](' || src || ')' WHEN 4 THEN '#### ' || l || chr(10) || chr(10) || '```mermaid' || chr(10) || 'Graph ' || b.ln || chr(10) || '```' WHEN 5 THEN '```mermaid' || chr(10) || l || chr(10) || '```' END AS md
  FROM b LEFT JOIN di ON di.page = b.page AND di.ln = b.ln)
 SELECT page, printf('%03d_s%d.md', s // 6 + 1, s) AS path, 'chapter' AS kind, md5('# ' || trim(any_value(head)) || chr(10) || chr(10) || coalesce(string_agg(replace(md, '#### ', '### '), chr(10) || chr(10) ORDER BY ln) FILTER (WHERE md IS NOT NULL), '') || chr(10)) AS digest FROM p GROUP BY page, s
 UNION ALL SELECT page, 'images/s' || (ln - ln % 6) || '-' || j || '.gif', 'image', md5('{PIXEL}') FROM di"""

ALL = {
    "sc14_images": (sc14, with_views(f"WITH {NUMBERED} SELECT page, n::INT AS n, md5(src) AS src, alt, caption, trim(head) AS section, pg AS page_no FROM ip", "v_lines")),
    "sc15_diagrams": (sc15, with_views(f"WITH {NUMBERED} SELECT page, n::INT AS n, title, kind, code, trim(head) AS section FROM dk", "v_lines")),
    "sc13_section_list": (sc13, with_views(f"""WITH {NUMBERED} SELECT page, (ln // 6 + 1)::INT AS n, 's' || ln AS id, trim(head) AS title,
 (SELECT sum(words + CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 1 - words WHEN 4 THEN 2 ELSE 0 END) FROM w v WHERE v.page = w.page AND v.ln // 6 = w.ln // 6)::BIGINT AS word_count,
 (SELECT count(*) FROM b v WHERE v.page = w.page AND v.ln // 6 = w.ln // 6 AND v.k IN (2, 3)) AS image_count, (SELECT count(*) FROM b v WHERE v.page = w.page AND v.ln // 6 = w.ln // 6 AND v.k IN (4, 5)) AS diagram_count FROM w WHERE k = 0""", "v_lines")),
    "f19_section_visuals": (f19, with_views(f"WITH {NUMBERED}, s AS (SELECT page, 's' || ln AS id, substr(regexp_replace(trim(head), '^\\d+\\.\\s*', ''), 1, 20) AS t FROM b WHERE k = 0) SELECT el.page, s.id, display_index::INT AS display_index FROM el JOIN s ON s.page = el.page AND contains(trim(el.section), s.t)", "v_lines")),
    "w15_element_index": (w15, with_views(f"WITH {NUMBERED} SELECT page, display_index::INT AS display_index, kind, n::INT AS n, title, trim(section) AS section, extra FROM el", "v_lines")),
    "sk12_saved_edits": (sk12, with_views(SAVED, "v_lines")),
    "sk10_export_names": (sk10_names, with_views("SELECT regexp_extract(path, '(src\\d+)\\.md$', 1) AS book, pos, printf('%03d_s%d.md', row_number() OVER (PARTITION BY regexp_extract(path, '(src\\d+)\\.md$', 1) ORDER BY pos), pos) AS file FROM v_chapters", "v_chapters")),
    "sk10_exported_sections": (sk10, with_views(EXPORT, "v_lines")),
}
