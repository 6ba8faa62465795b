"""Queries on Markdown and HTML. Documents become chapters with headings, fences, quotes, lists and tables; where the outcome
follows from that derivation it is written as SQL, the others are held against golden values in the tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as X
from ..operators import corpus as C
from ..operators import splitting as S
from ..sources import corpus as source
from .views import v_bands, v_chapters, v_html, v_lines, with_views


def _md_lines(spark, d):
    """Each line as a Markdown block, by its number."""
    ln, line = F.col("ln"), F.regexp_replace("line", "[^\\p{L}\\p{N} ]", "")
    block = (
        F.when(ln % 10 == 2, F.concat(F.lit("## "), line)).when(ln % 10 == 4, F.concat(F.lit("```py\n## "), line, F.lit("\n```")))
        .when(ln % 10 == 6, F.concat(F.lit("> ```\n> ## "), line, F.lit("\n> ```"))).when(ln % 10 == 8, F.concat(F.lit("@@HTML_START@@\n## <b>"), line, F.lit("</b>\n@@HTML_END@@")))
        .when(ln % 10 == 9, F.concat(F.lit("| a | b |\n|---|---|\n| "), line, F.lit(" | 1 |"))).otherwise(line)
    )
    return v_lines(spark, d).select("doc", "page", "ln", block.alias("block"))


def v_md(spark, d):
    body = X.ordered_concat(F.col("block"), [F.col("ln")], "\n\n")
    return _md_lines(spark, d).groupBy("page").agg(F.concat(F.lit("# Title\n\n"), body).alias("text"))


def w16(spark, d):
    p = S.split_pieces(v_md(spark, d), "page", "text")
    return p.select("page", "piece_ix", F.md5("md").alias("digest"))


def f22(spark, d):
    lines = v_md(spark, d).select("page", F.split("text", "\n").alias("l"))
    return lines.select("page", F.size(F.filter(S.open_lines(F.col("l")), lambda x: x)).alias("n_open"), F.size("l").alias("n_lines"))


def g1(spark, d):
    """Pieces of all chapters; a piece's label is the chapter's title only if there are several."""
    p = S.split_pieces(v_md(spark, d), "page", "text")
    n = F.count(F.lit(1)).over(Window.partitionBy("page"))
    return p.select("page", "piece_ix", F.when(n > 1, F.lit("Title")).alias("group_label"))


def x14(spark, d):
    r = v_md(spark, d).select("page", "text", M.protected_blocks("text").alias("p"))
    return r.select("page", F.size("p.blocks").alias("n_blocks"), F.regexp_count("p.text", F.lit("@@TBLOCK_")).alias("n_marks"), (F.length("p.text") < F.length("text")).alias("shorter"))


def x15(spark, d):
    h = v_md(spark, d).select("page", M.markdown_to_html("text").alias("html"))
    n = lambda p: F.regexp_count("html", F.lit(p))
    return h.select("page", n("<h1").alias("h1"), n("<h2").alias("h2"), n("<pre>").alias("pre"), n("lf-html-block").alias("raw"), n('<div class="table-wrap">').alias("tables"))


def x17(spark, d):
    back = M.html_to_markdown(M.markdown_to_html("text"))
    r = v_md(spark, d).select("page", back.alias("md"))
    return r.select("page", F.regexp_count("md", F.lit("(?m)^```py$")).alias("n_code"), F.regexp_count("md", F.lit("(?m)^\\| --- ")).alias("n_tables"))


def x18(spark, d):
    """Code keeps its language on the way to HTML and back."""
    code = F.concat(F.lit("```"), F.element_at(F.array(*map(F.lit, ("py", "sql", "js"))), (F.col("pos") % 3 + 1).cast("int")), F.lit("\n"), F.regexp_replace("title", "[^A-Za-z]", ""), F.lit("\n```"))
    return v_chapters(spark, d).select("pos", M.html_to_markdown(M.markdown_to_html(code)).alias("md"))


def g4(spark, d):
    row = F.concat(F.lit("| "), F.regexp_replace("title", "[^A-Za-z]", ""), F.lit(" | a\\|b | `x|y` | "), F.col("pos").cast("string"), F.lit(" |"))
    return v_chapters(spark, d).select("pos", F.posexplode(M.table_cells(row)).alias("ix", "cell"))


def w19(spark, d):
    """Labels of two capitals and digits: what they wrap to is known by counting."""
    return v_chapters(spark, d).select("pos", M.wrapped_label(F.concat(F.lit("item "), F.lpad(F.col("pos").cast("string"), 8, "0"), F.lit(" of "), F.lpad(F.col("pos").cast("string"), 8, "0"))).alias("label"))


def x26(spark, d):
    """Line breaks in quoted labels become a literal \\n; titles of subgraphs stay."""
    code = F.concat(F.lit('A["x<br/>'), (F.col("pos") % 100).cast("string"), F.lit('"]\nsubgraph S["x<br/>y"]'))
    return v_chapters(spark, d).select("pos", diagram_wrapped(code).alias("code"))


def g8(spark, d):
    n = M.html_nodes(v_html(spark, d), "page_id", "html")
    return n.filter("tag <> '#text'").groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("n_a"), F.count_if(F.col("tag") == "h1").alias("n_h1"), F.count_if(F.col("tag") == "li").alias("n_li"))


def f20(spark, d):
    """Text that a search looks at: not within code, scripts or styles, and not blank."""
    n = M.html_nodes(v_html(spark, d), "page_id", "html")
    parents = n.select("page_id", F.col("ix").alias("parent"), F.col("tag").alias("ptag"))
    shown = n.filter("tag = '#text'").join(parents, ["page_id", "parent"], "left").filter("coalesce(ptag, '') not in ('script', 'style', 'pre', 'code', 'mark')")
    return shown.filter(X.strip(F.col("text")) != "").groupBy("page_id").agg(F.count_if(F.lower("text").contains("track(")).alias("n_script_text"), (F.count(F.lit(1)) > 0).alias("has_text"))


def f23(spark, d):
    html = F.concat(F.lit("<section><figure>a</figure><div class='"), F.element_at(F.array(*map(F.lit, ("tip-box", "x mermaid", "my-8", "plain"))), (F.col("pos") % 4 + 1).cast("int")), F.lit("'><p>t</p></div></section>"))
    n = M.html_nodes(v_chapters(spark, d).select("pos", html.alias("html")), "pos", "html")
    cls = F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), " ")
    kind = F.when(F.col("tag") == "figure", "figure").when(F.col("tag") != "div", F.lit(None)).when(F.array_contains(cls, "tip-box"), "tip-box").when(F.array_contains(cls, "mermaid"), "diagram")
    return n.withColumn("kind", kind).filter("kind is not null").select("pos", "kind")


def g9(spark, d):
    """Quotes cut before each paragraph, tips and others in runs."""
    html = F.concat(F.lit("<p>TIP: a</p><p>TIP b</p><p>"), F.regexp_replace("title", "[^A-Za-z]", ""), F.lit("</p>"), F.when(F.col("pos") % 2 == 0, F.lit("<p>TIP c</p>")).otherwise(""))
    segs = v_chapters(spark, d).select("pos", F.posexplode(F.split(html, "(?=<p[\\s>])")).alias("ix", "seg")).filter(X.strip(F.col("seg")) != "")
    tip = X.strip(X.strip_tags(F.col("seg"))).rlike("^\\s*(TIP)")
    w = Window.partitionBy("pos").orderBy("ix")
    r = segs.withColumn("tip", tip)
    r = r.withColumn("run", F.sum(F.when(F.col("tip").eqNullSafe(F.lag("tip").over(w)), 0).otherwise(1)).over(w))
    return r.groupBy("pos", "run", "tip").agg(X.ordered_concat(F.col("seg"), [F.col("ix")], "").alias("html")).select("pos", F.col("run").cast("int").alias("run"), "tip", "html")


def w18(spark, d):
    """Cuts of tall figures: the bands of each order as shapes."""
    g = v_bands(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.array(F.col("y0").cast("double"), F.col("y1").cast("double")))).alias("bands"), F.max("y1").cast("double").alias("h"))
    cuts = S.figure_cuts("h", "bands", F.lit(400.0), (F.col("id") % 400).cast("double"))
    return g.select("id", F.posexplode(cuts).alias("ix", "y"))


def _ids(spark, d):
    """Ids with repeats, and some that look like the ones given out for repeats."""
    i = F.col("pos")
    ids = F.when(i % 5 == 0, F.concat("title", F.lit("_2"))).when(i % 7 == 0, F.concat("title", F.lit("_"), (i % 6).cast("string"))).otherwise(F.col("title"))
    return v_chapters(spark, d).select(F.regexp_extract("path", "(src\\d+)\\.md$", 1).alias("book"), "pos", ids.alias("id"))


def w2(spark, d):
    return S.unique_ids(_ids(spark, d), "book", "pos").select("book", "pos", "id", "new_id")


def w2_links(spark, d):
    """A table of contents whose links follow the renamed sections."""
    ids = _ids(spark, d)
    links = ids.select("book", F.col("pos").alias("ix"), F.concat(F.lit("#"), "id").alias("href"))
    return S.followed_links(links, S.unique_ids(ids, "book", "pos"), "book")


def sk8(spark, d):
    """Imported chapters: a title, the body, and whether the book's configuration has to split them."""
    m = v_md(spark, d)
    return m.select("page", F.md5(F.concat(F.lit("# doc\n\n"), "text", F.lit("\n"))).alias("digest"), F.col("text").rlike("(?md)^##\\s+\\S").alias("split"))


def sc3(spark, d):
    """The first root file of each source with a toc fence."""
    toc = F.when(F.col("pos") % 20 == 0, F.concat(F.lit("x\n```toc\n1|"), "title", F.lit("|1|s|k\nshort|row\n```\n"))).otherwise(F.col("text"))
    c = v_chapters(spark, d).withColumn("text", toc).filter("not contains(path, '/')").filter(F.col("text").rlike("(?s)```toc\\s*\\n.*?```"))
    return c.groupBy(F.regexp_extract("path", "(src\\d+)\\.md$", 1).alias("book")).agg(F.min_by("pos", F.struct("path", "pos")).alias("pos"))


def sc4(spark, d):
    """Rows of toc fences with four fields or more."""
    toc = F.concat(F.lit("```toc\n1|"), F.regexp_replace("title", "[^A-Za-z]", ""), F.lit("|"), F.col("pos").cast("string"), F.lit("|slug|kind\n\n too|short\n2|b|3|s\n```"))
    lines = v_chapters(spark, d).select("pos", F.explode(F.split(F.regexp_extract(toc, "(?s)```toc\\s*\\n(.*?)```", 1), "\n")).alias("line"))
    f = lines.withColumn("f", F.split(F.trim("line"), "\\|")).filter("size(f) >= 4")
    return f.select("pos", F.concat(F.lit("Part "), F.col("f")[0], F.lit(". "), F.col("f")[1]).alias("label"), F.col("f")[2].alias("chapter_no"))


def sc7(spark, d):
    """Reading order of books of four kinds: with a listing, with a toc, named by parts and chapters, and neither."""
    kind = F.regexp_extract("book", "(\\d+)$", 1).cast("int") % 4
    c = v_chapters(spark, d).withColumn("book", F.regexp_extract("path", "(src\\d+)\\.md$", 1))
    path = F.when(kind == 3, F.replace("path", F.lit("Part_"), F.lit("Sec_"))).otherwise(F.col("path"))
    files = c.select("book", path.alias("path")).distinct().withColumn("text", F.lit("# x"))
    books = c.select("book").distinct()
    toc = F.concat(F.lit("# toc\n```toc\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.concat((F.floor(i / 30) + 1).cast("string"), F.lit("|T|"), (i % 30).cast("string"), F.lit("|s"))), "\n"), F.lit("\nshort|row\n```\n"))
    files = files.unionByName(books.filter(kind == 1).select("book", F.lit("50_toc.md").alias("path"), toc.alias("text")))
    config = F.when(kind == 0, F.lit("order:\n  files: ['Appendix/*.md', 'notes/n1*.md', gone.md]\n")).when(kind == 2, F.lit("exclude: ['*_top_*']\n"))
    return source.resolve_books(files, books.withColumn("config", config))


def sc1(spark, d):
    """All chapters that aren't excluded, in natural order of their paths."""
    c = C.excluded(v_chapters(spark, d), ["*_src1.md"]).withColumn("key", X.natural_key(F.col("path")))
    return C.ranked(c, ["key", "path", "pos"], "pos_out").select("pos", "path", "pos_out")


def sc21(spark, d):
    """Paths that may be served: within the book's folder by whole components."""
    p = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("/book/../"), "path")).when(F.col("pos") % 3 == 1, F.concat(F.lit("/bookish/"), "path")).otherwise(F.concat(F.lit("/book/./"), "path"))
    full = C.normalised_path(F.lit(None).cast("string"), p)
    return v_chapters(spark, d).select("pos", (F.split(full, "/")[0] == "book").alias("allowed"))


@F.pandas_udf(M.StringType())
def diagram_wrapped(s):
    return s.map(lambda x: None if x is None else M.wrap_diagram(x))


MD = """ml AS (SELECT page, ln, regexp_replace(line, '[^\\p{L}\\p{N} ]', '', 'g') AS l FROM v_lines),
 mb AS (SELECT page, ln, CASE ln % 10 WHEN 2 THEN '## ' || l WHEN 4 THEN '```py' || chr(10) || '## ' || l || chr(10) || '```' WHEN 6 THEN '> ```' || chr(10) || '> ## ' || l || chr(10) || '> ```'
 WHEN 8 THEN '@@HTML_START@@' || chr(10) || '## <b>' || l || '</b>' || chr(10) || '@@HTML_END@@' WHEN 9 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || l || ' | 1 |' ELSE l END AS block, trim(l) <> '' AS has FROM ml)"""
PIECES = """bd AS (SELECT *, CASE WHEN ln % 10 = 2 AND has THEN 1 ELSE 0 END AS b FROM mb), sg AS (SELECT *, sum(b) OVER (PARTITION BY page ORDER BY ln) AS seg FROM bd),
 md AS (SELECT page, seg, string_agg(CASE WHEN b = 1 THEN substr(block, 2) ELSE block END, chr(10) || chr(10) ORDER BY ln) AS t, bool_or(trim(block) <> '') AS body, min(ln) AS first FROM sg GROUP BY ALL),
 al AS (SELECT page, 0 AS seg FROM (SELECT DISTINCT page FROM sg) UNION SELECT page, seg FROM md),
 pc AS (SELECT page, seg, CASE WHEN seg = 0 THEN '# Title' || chr(10) || chr(10) || coalesce(t, '') || CASE WHEN mx > 0 AND t IS NOT NULL THEN chr(10) ELSE '' END ELSE t || CASE WHEN seg < mx THEN chr(10) ELSE '' END END AS t, coalesce(body, false) AS body, mx
  FROM (SELECT al.page, al.seg, t, body, max(al.seg) OVER (PARTITION BY al.page) AS mx FROM al LEFT JOIN md ON md.page = al.page AND md.seg = al.seg)),
 pieces AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY seg) - 1 AS piece_ix, t FROM pc WHERE seg > 0 OR body OR mx = 0)"""
BOOK = "regexp_extract(path, '(src\\d+)\\.md$', 1)"

NATURAL = "list_transform(regexp_extract_all(lower(path), '\\d+|\\D+'), lambda r: CASE WHEN regexp_matches(r, '^\\d') THEN lpad(r, 20, '0') ELSE r END)"
# the numbers from 2 that no id of the book takes, in order, to the repeats of an id
UNIQUE = f"""o AS (SELECT {BOOK} AS book, pos, CASE WHEN pos % 5 = 0 THEN title || '_2' WHEN pos % 7 = 0 THEN title || '_' || (pos % 6) ELSE title END AS id FROM v_chapters),
 r AS (SELECT *, row_number() OVER (PARTITION BY book, id ORDER BY pos) AS n FROM o),
 m AS (SELECT book, id, count(*) AS m FROM o GROUP BY ALL), k AS (SELECT book, id, unnest(range(2, m + 2000)) AS k FROM m WHERE m > 1),
 free AS (SELECT book, id, k, row_number() OVER (PARTITION BY book, id ORDER BY k) + 1 AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.book = k.book AND o.id = k.id || '_' || k.k)),
 named AS (SELECT r.book, r.pos, r.id, r.n, CASE WHEN r.n = 1 THEN r.id ELSE r.id || '_' || free.k END AS new_id FROM r LEFT JOIN free ON free.book = r.book AND free.id = r.id AND free.n = r.n)"""

ALL = {
    "w16_heading_split": (w16, with_views(f"WITH {MD}, {PIECES} SELECT page, piece_ix::INT AS piece_ix, md5(t) AS digest FROM pieces", "v_lines")),
    "f22_protected_zones": (f22, with_views(f"WITH {MD} SELECT page, (sum(CASE ln % 10 WHEN 4 THEN 0 WHEN 6 THEN 0 WHEN 8 THEN 0 WHEN 9 THEN 3 ELSE 1 END) + count(*) + 1)::INT AS n_open, (sum(CASE WHEN ln % 10 IN (4, 6, 8, 9) THEN 3 ELSE 1 END) + count(*) + 1)::INT AS n_lines FROM mb GROUP BY page", "v_lines")),
    "g1_split_pieces": (g1, with_views(f"WITH {MD}, {PIECES} SELECT page, piece_ix::INT AS piece_ix, CASE WHEN count(*) OVER (PARTITION BY page) > 1 THEN 'Title' END AS group_label FROM pieces", "v_lines")),
    "x14_protect_blocks": (x14, with_views(f"WITH {MD} SELECT page, count(*) FILTER (WHERE ln % 10 IN (4, 6, 8))::INT AS n_blocks, count(*) FILTER (WHERE ln % 10 IN (4, 6, 8))::INT AS n_marks, count(*) FILTER (WHERE ln % 10 IN (4, 6, 8)) > 0 AS shorter FROM mb GROUP BY page", "v_lines")),
    "x15_markdown_to_html": (x15, with_views(f"WITH {MD} SELECT page, 1 AS h1, count(*) FILTER (WHERE ln % 10 = 2)::INT AS h2, count(*) FILTER (WHERE ln % 10 IN (4, 6))::INT AS pre, count(*) FILTER (WHERE ln % 10 = 8)::INT AS raw, count(*) FILTER (WHERE ln % 10 = 9)::INT AS tables FROM mb GROUP BY page", "v_lines")),
    "x17_html_to_markdown": (x17, with_views(f"WITH {MD} SELECT page, count(*) FILTER (WHERE ln % 10 = 4)::INT AS n_code, count(*) FILTER (WHERE ln % 10 = 9)::INT AS n_tables FROM mb GROUP BY page", "v_lines")),
    "x18_code_language": (x18, with_views("SELECT pos, '```' || ['py','sql','js'][pos % 3 + 1] || chr(10) || regexp_replace(title, '[^A-Za-z]', '', 'g') || chr(10) || '```' AS md FROM v_chapters", "v_chapters")),
    "g4_table_cells": (g4, with_views("SELECT pos, (generate_subscripts(c, 1) - 1)::INT AS ix, unnest(c) AS cell FROM (SELECT pos, [regexp_replace(title, '[^A-Za-z]', '', 'g'), 'a\\|b', '`x|y`', pos::VARCHAR] AS c FROM v_chapters)", "v_chapters")),
    "w19_label_wrap": (w19, with_views("SELECT pos, 'item ' || lpad(pos::VARCHAR, 8, '0') || ' of' || '\\n' || lpad(pos::VARCHAR, 8, '0') AS label FROM v_chapters", "v_chapters")),
    "x26_diagram_labels": (x26, with_views("SELECT pos, 'A[\"x\\n' || (pos % 100) || '\"]' || chr(10) || 'subgraph S[\"x<br/>y\"]' AS code FROM v_chapters", "v_chapters")),
    "g8_node_walk": (g8, with_views("SELECT page_id, len(regexp_extract_all(html, '<a[ >]')) AS n_a, len(regexp_extract_all(html, '<h1[ >]')) AS n_h1, len(regexp_extract_all(html, '<li[ >]')) AS n_li FROM v_html", "v_html")),
    "f20_search_nodes": (f20, with_views("SELECT page_id, 0::BIGINT AS n_script_text, true AS has_text FROM v_html", "v_html")),
    "f23_preserved_kinds": (f23, with_views("SELECT pos, 'figure' AS kind FROM v_chapters UNION ALL SELECT pos, ['tip-box','diagram'][pos % 4 + 1] FROM v_chapters WHERE pos % 4 < 2", "v_chapters")),
    "g9_quote_segments": (g9, with_views("""SELECT pos, 1 AS run, true AS tip, '<p>TIP: a</p><p>TIP b</p>' AS html FROM v_chapters UNION ALL SELECT pos, 2, false, '<p>' || regexp_replace(title, '[^A-Za-z]', '', 'g') || '</p>' FROM v_chapters
 UNION ALL SELECT pos, 3, true, '<p>TIP c</p>' FROM v_chapters WHERE pos % 2 = 0""", "v_chapters")),
    "w18_page_cuts": (w18, None),
    "w2_unique_ids": (w2, with_views(f"WITH {UNIQUE} SELECT book, pos, id, new_id FROM named", "v_chapters")),
    "w2_toc_links": (w2_links, with_views(f"""WITH {UNIQUE}, l AS (SELECT *, row_number() OVER (PARTITION BY book, id ORDER BY pos) - 1 AS place FROM o)
 SELECT l.book, l.pos AS ix, '#' || coalesce(m.new_id, l.id) AS href FROM l LEFT JOIN named m ON m.book = l.book AND m.id = l.id AND m.n > 1 AND l.place = 2 * (m.n - 1) - 1""", "v_chapters")),
    "sk8_imported_corpus": (sk8, with_views(f"WITH {MD} SELECT page, md5('# doc' || chr(10) || chr(10) || '# Title' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY ln) || chr(10)) AS digest, bool_or((ln % 10 = 2 AND has) OR ln % 10 IN (4, 8)) AS split FROM mb GROUP BY page", "v_lines")),
    "sc3_toc_discovery": (sc3, with_views(f"SELECT {BOOK} AS book, arg_min(pos, (path, pos)) AS pos FROM v_chapters WHERE NOT contains(path, '/') AND pos % 20 = 0 GROUP BY ALL", "v_chapters")),
    "sc4_toc_rows": (sc4, with_views("SELECT pos, 'Part 1. ' || regexp_replace(title, '[^A-Za-z]', '', 'g') AS label, pos::VARCHAR AS chapter_no FROM v_chapters UNION ALL SELECT pos, 'Part 2. b', '3' FROM v_chapters", "v_chapters")),
    "sc7_tiers": (sc7, with_views(f"""WITH f AS (SELECT DISTINCT book, k, CASE WHEN k = 3 THEN replace(path, 'Part_', 'Sec_') ELSE path END AS path FROM (SELECT {BOOK} AS book, regexp_extract({BOOK}, '\\d+')::INT % 4 AS k, path FROM v_chapters)),
 g AS (SELECT * FROM f UNION SELECT book, k, '50_toc.md' FROM f WHERE k = 1), n AS (SELECT *, {NATURAL} AS nk, path LIKE 'Part\\_%' ESCAPE '\\' AS part, contains(path, '/') AS deep, try_cast(regexp_extract(path, '^(\\d+)[^/]*$', 1) AS INT) AS no, regexp_extract(path, '^Part_([IVX]+)_', 1) AS roman FROM g),
 e AS (SELECT book, 0 AS tier, CASE WHEN path LIKE 'Appendix/%' THEN 0 ELSE 1 END AS a, nk, path, NULL AS part_label FROM n WHERE k = 0 AND (path LIKE 'Appendix/%' OR path LIKE 'notes/n1%')),
 t AS (SELECT book, 1 AS tier, p * 30 + c AS a, [] AS nk, min(path) AS path, 'Part ' || (p + 1) || '. T' AS part_label FROM n, (SELECT unnest([0, 1]) AS p), (SELECT unnest(range(30)) AS c)
  WHERE k = 1 AND path LIKE 'Part\\_' || ['I', 'II'][p + 1] || '\\_%' ESCAPE '\\' AND regexp_extract(path, 'Chapter_(\\d+)_', 1)::INT = c GROUP BY book, p, c),
 kept AS (SELECT * FROM n WHERE k <> 2 OR NOT contains(path, '_top_')),
 v AS (SELECT book, 2 AS tier, CASE WHEN NOT deep AND coalesce(no, 0) < 50 THEN 0 WHEN part THEN 1000 + CASE roman WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'IV' THEN 4 ELSE 10 END WHEN NOT deep THEN 2000 ELSE 3000 END AS a, nk, path,
  CASE WHEN part THEN roman || '부. some name' WHEN deep THEN 'Appendix' END AS part_label FROM kept WHERE (part OR NOT deep OR path LIKE 'Appendix/%') AND book IN (SELECT book FROM kept WHERE part)),
 u AS (SELECT book, 3 AS tier, 0 AS a, nk, path, NULL AS part_label FROM kept), x AS (SELECT * FROM e UNION ALL SELECT * FROM t UNION ALL SELECT * FROM v UNION ALL SELECT * FROM u)
 SELECT book, ['explicit', 'toc', 'convention', 'natural'][tier + 1] AS tier, row_number() OVER (PARTITION BY book ORDER BY a, nk, path)::INT AS pos_out, path, part_label FROM x WHERE tier = (SELECT min(tier) FROM x y WHERE y.book = x.book)""", "v_chapters")),
    "sc1_corpus_scan": (sc1, with_views("SELECT pos, path, row_number() OVER (ORDER BY list_transform(regexp_extract_all(lower(CASE WHEN regexp_matches(path, '^\\d') THEN path ELSE path END), '\\d+|\\D+'), lambda r: CASE WHEN regexp_matches(r, '^\\d') THEN lpad(r, 20, '0') ELSE r END), path, pos) AS pos_out FROM v_chapters WHERE NOT path GLOB '*_src1.md'", "v_chapters")),
    "sc21_path_allowed": (sc21, with_views("SELECT pos, pos % 3 = 2 OR (pos % 3 = 0 AND path LIKE 'book/%') AS allowed FROM v_chapters", "v_chapters")),
}
