"""Queries on translation state, chunks, outcomes and edits, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..operators import editing as E
from ..operators import translation as T
from .views import v_chapters, v_html, v_images, v_lines, v_sections, v_translations, with_views


def _t(spark, d):
    return v_translations(spark, d)


def f9(spark, d):
    return _t(spark, d).select("chunk_ix", F.round(T.hangul_ratio(F.col("result")), 6).alias("ratio"), (T.hangul_ratio(F.col("result")) > 0.05).alias("residual"))


def f10(spark, d):
    return _t(spark, d).select("chunk_ix", T.is_echo(F.col("original"), F.col("result")).alias("echo"))


def _failed(spark, d):
    return _t(spark, d).withColumn("failed", T.chunk_failed(F.col("original"), F.col("result"), F.col("lang")))


def f11(spark, d):
    return _failed(spark, d).select("path", "chunk_ix", "lang", "failed")


def f12(spark, d):
    return _t(spark, d).select("chunk_ix", T.cell_needs(F.col("result"), F.col("lang")).alias("needs"))


def f13(spark, d):
    return _t(spark, d).select("chunk_ix", T.cell_hallucinated(F.col("original"), F.col("result")).alias("bad"))


def a14(spark, d):
    return _failed(spark, d).groupBy("path").agg(F.count_if(~F.col("failed")).alias("ok"), F.count_if("failed").alias("fail"), (F.count_if("failed") > 0).alias("is_error"))


def a17(spark, d):
    numbered = _failed(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("chunk_ix")))
    return numbered.filter("failed").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("n")), ",").alias("chunks"), F.count(F.lit(1)).alias("n_failed"))


def _marks(spark, d):
    """Markers of an earlier run: the failed chunks of some paths, some without cached chunks."""
    numbered = _failed(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("chunk_ix")))
    g = numbered.groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("n")))).alias("incomplete_chunks"), F.count(F.lit(1)).cast("int").alias("total_chunks"), F.min("chunk_ix").alias("k"))
    return g


def sc18(spark, d):
    """Markers as JSON, read back with an explicit schema."""
    m = _marks(spark, d).filter("size(incomplete_chunks) > 0")
    js = F.to_json(F.struct("incomplete_chunks", "total_chunks", F.lit(2000).alias("chunk_chars")))
    r = m.select("path", F.from_json(js, "incomplete_chunks array<int>, total_chunks int, chunk_chars int, chunks array<string>").alias("m"))
    return r.select("path", F.array_join("m.incomplete_chunks", ",").alias("incomplete"), F.col("m.total_chunks").alias("total_chunks"), F.col("m.chunks").isNull().alias("no_chunks"))


def t1(spark, d):
    m = _marks(spark, d)
    k = F.col("k")
    return m.select("path", T.resume_action(F.col("total_chunks") > 3, k % 3 != 0, F.size("incomplete_chunks") > 0, k % 4 != 1, k % 5 != 2).alias("action"))


def j13(spark, d):
    chapters = v_chapters(spark, d).select("pos", F.concat(F.regexp_extract("path", "(src\\d+)\\.md$", 1), F.lit("/"), F.floor(F.col("pos") / 50).cast("long").cast("string"), F.lit(".md")).alias("path"))
    m = _marks(spark, d).filter("size(incomplete_chunks) > 0").select("path", F.col("total_chunks"))
    return chapters.join(m, "path", "left").select("pos", "path", "total_chunks")


def sk5(spark, d):
    m = _marks(spark, d).select("path", "incomplete_chunks", "total_chunks", "k")
    before = m.filter("k % 2 = 0").withColumn("total_chunks", F.lit(1))
    after = T.marker_upsert(before, m.filter("k % 3 <> 0"))
    return after.select("path", F.array_join("incomplete_chunks", ",").alias("incomplete"), "total_chunks")


def t5(spark, d):
    """Last write per section over a log of three writes each."""
    s = v_sections(spark, d)
    log = s.select("id", F.explode(F.array(F.lit(1), F.lit(3), F.lit(2))).alias("seq"), "pos").withColumn("op", F.when((F.col("pos") + F.col("seq")) % 4 == 0, "deleted").otherwise("edit"))
    return E.latest(log.select("id", "seq", "op")).select("id", "seq", "op")


def f14(spark, d):
    """Tables among chunks: a header, a separator with as many cells, no blank line."""
    from ..functions.markdown import is_table

    head = F.concat(F.lit("| a | "), F.regexp_replace("original", "[^A-Za-z]", " "), F.lit(" |\n"))
    sep = F.when(F.col("chunk_ix") % 3 == 0, F.lit("|---|:-:|")).when(F.col("chunk_ix") % 3 == 1, F.lit("|---|")).otherwise(F.lit("text"))
    return _t(spark, d).select("chunk_ix", is_table(F.concat(head, sep, F.lit("\n| 1 | 2 |"))).alias("is_table"))


def w17(spark, d):
    """Lines as paragraphs, filled into chunks of at most 300 characters."""
    lines = v_lines(spark, d).filter(X.strip(F.col("line")) != "")
    paras = F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda r: r.line)
    g = lines.groupBy("page").agg(paras.alias("p"))
    return g.select("page", F.posexplode(T.pack_paragraphs(F.col("p"), 300)).alias("ix", "chunk")).select("page", "ix", F.md5("chunk").alias("digest"), F.length("chunk").alias("n"))


def x23(spark, d):
    return _t(spark, d).select("chunk_ix", F.md5(T.prompt(F.col("original"), F.col("lang"))).alias("digest"))


def x24(spark, d):
    w = Window.partitionBy("path")
    n = _t(spark, d).withColumn("n", F.row_number().over(w.orderBy("chunk_ix"))).withColumn("total", F.count(F.lit(1)).over(w))
    return n.select("chunk_ix", F.format_string("[%d/%d] %s", F.col("n"), F.col("total"), F.col("path")).alias("label"))


def x25(spark, d):
    return _t(spark, d).select("chunk_ix", F.split("original", "\n")[0].alias("first_line"))


def f18(spark, d):
    return v_sections(spark, d).select("id", E.status(F.col("op")).alias("status"))


def x21(spark, d):
    new = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("7. "), F.col("new_title"))).otherwise(F.col("new_title"))
    old = F.when(F.col("pos") % 2 == 0, F.col("title")).otherwise(F.regexp_extract("title", "^\\d+\\. (.*)$", 1))
    return v_sections(spark, d).select("id", E.numbered_title(old, new).alias("title"))


def _log(spark, d):
    s = v_sections(spark, d)
    known = s.filter("op is not null").select("id", F.lit(1).alias("seq"), "op", F.col("new_title").alias("title"), F.concat(F.lit("+"), F.col("text")).alias("markdown"))
    return known.unionByName(s.filter("pos % 6 = 0").select(F.concat(F.lit("x"), "id").alias("id"), F.lit(1).alias("seq"), F.lit("edit").alias("op"), "title", F.col("text").alias("markdown")))


def j12(spark, d):
    out = E.apply_edits(v_sections(spark, d).drop("op"), _log(spark, d))
    return out.select("id", "title", F.md5("text").alias("digest"))


def sk12(spark, d):
    """Links between sections after deletions: to a deleted one, plain text."""
    s = v_sections(spark, d)
    links = s.select("id", F.concat(F.lit("#s"), ((F.col("pos") * 7 + 3) % 1000).cast("string")).alias("target"), F.lit("see").alias("text"))
    return E.unlink_dead(links, s.filter("op = 'deleted'").select("id")).select("id", "target", "html")


def j10(spark, d):
    """Images of the editor to the live images, by the k-th of a source."""
    editor = v_images(spark, d).select("doc", "src", F.struct("page", "pos").alias("e"))
    live = v_images(spark, d).select("doc", "src", F.struct(-F.col("page"), -F.col("pos")).alias("l"))
    key = lambda df: df.withColumn("k", F.concat_ws("|", "doc", "src"))
    m = C.rank_matched(key(editor).drop("doc", "src"), key(live).drop("doc", "src"), "k", "e", "l")
    return m.select("k", F.col("e.page").alias("e_page"), F.col("e.pos").alias("e_pos"), (-F.col("l.col1")).alias("l_page"), (-F.col("l.col2")).alias("l_pos"))


def j11(spark, d):
    """Diagrams to the first page that holds the first 40 characters of their code."""
    pages = v_chapters(spark, d).select(F.col("pos").alias("text_id"), F.col("text").alias("body"))
    needles = v_chapters(spark, d).filter("n_chars >= 60").select(F.col("pos").alias("needle_id"), F.substring("text", 11, 50).alias("code"))
    return C.first_contained(needles, pages)


def w20(spark, d):
    lines = v_lines(spark, d)
    kind = F.when(F.col("ln") % 3 == 1, "figure").when(F.col("ln") % 5 == 4, "tip-box").otherwise("content")
    nodes = lines.select(F.col("page").alias("id"), F.col("ln").alias("ix"), kind.alias("kind"), F.md5("line").alias("html"))
    fresh = lines.filter("ln % 4 = 0").select(F.col("page").alias("id"), F.col("ln").alias("ix"), F.lit("new").alias("html"))
    return E.reinserted(nodes, fresh)


def a15(spark, d):
    kinds = F.array(*map(F.lit, ("image_delete", "image_replace", "image_add", "diagram_delete", "section_edit", "section_delete", "none")))
    return E.summary(v_sections(spark, d).select("source", F.element_at(kinds, (F.col("pos") % 7 + 1).cast("int")).alias("change")), ["source"])


def f2(spark, d):
    return v_chapters(spark, d).agg((F.count(F.lit(1)) == 0).alias("is_empty"), F.count(F.lit(1)).alias("n_chapters"))


def f17(spark, d):
    """Tip markers: none never match; others match at the start, escaped."""
    import re

    markers = ["The", "A.", "*"]
    pattern = "^\\s*(" + "|".join(re.escape(m) for m in markers) + ")"
    return v_lines(spark, d).select("page", "ln", F.col("line").rlike(pattern).alias("is_tip"))


# Languages whose code is highlighted.
HIGHLIGHTED = ["python", "bash", "shell", "sh", "yaml", "json", "javascript", "js", "html", "css", "sql"]


def f21(spark, d):
    lang = F.element_at(F.array(*map(F.lit, ("python", "bash", "mermaid", "dockerfile", "sh", "css", "brainf"))), (F.col("pos") % 7 + 1).cast("int"))
    known = HIGHLIGHTED
    cls = lambda allowed: F.when(lang.isin(allowed), F.concat(F.lit("language-"), lang)).otherwise("plain-code")
    return v_chapters(spark, d).select("pos", cls(known).alias("html_class"), cls([*known, "dockerfile"]).alias("pdf_class"))


def math(spark, d):
    """Shrink-to-fit scale that never enlarges, and its height; half-point sizes."""
    scale = F.least(F.lit(1.0), F.lit(40.0) / F.greatest(F.col("width"), F.lit(1.0)))
    return v_images(spark, d).select("doc", "page", "pos", F.round(scale, 6).alias("scale"), F.ceil(F.round(F.col("height") * scale, 6)).alias("h"), (F.bround(F.col("width") * 0.25 * 2) / 2).alias("half"))


def width(spark, d):
    wide = F.concat("original", F.when(F.col("chunk_ix") % 2 == 0, F.lit("한글漢字")).otherwise(""))
    return _t(spark, d).select("chunk_ix", X.visual_width(wide).alias("width"))


def toggle(spark, d):
    """The element toggle: deleted becomes active, anything else becomes deleted, by display index."""
    s = v_sections(spark, d).withColumn("ix", F.row_number().over(Window.partitionBy("source").orderBy("pos")))
    return s.select("source", "ix", F.when(E.status(F.col("op")) == "deleted", "active").otherwise("deleted").alias("next"))


def x19(spark, d):
    """Hard-wrap repair of plain prose: each document's lines as wrapped lines."""
    from ..operators.paragraphs import repair

    return repair(v_lines(spark, d).withColumn("line", F.when(F.col("ln") % 4 == 1, F.concat(F.regexp_replace("line", "[.!?:]+$", ""), F.lit("-"))).when(F.col("ln") % 4 == 3, F.lower("line")).otherwise(F.col("line"))))


FAILED = """fl AS (SELECT *, coalesce(CASE lang WHEN 'en' THEN CASE WHEN length(result) = 0 THEN false ELSE len(regexp_extract_all(result, '[가-힣]')) / length(result) > 0.05 END
 WHEN 'ko' THEN regexp_replace(original, '^\\s+|\\s+$', '', 'g') = regexp_replace(result, '^\\s+|\\s+$', '', 'g') AND len(regexp_extract_all(original, '[A-Za-z]')) >= 20 END, false) AS failed FROM v_translations),
 nf AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY chunk_ix) AS n, count(*) OVER (PARTITION BY path) AS total FROM fl),
 marks AS (SELECT path, coalesce(list(n ORDER BY n) FILTER (WHERE failed), []) AS inc, count(*)::INT AS total_chunks, min(chunk_ix) AS k FROM nf GROUP BY path)"""
V = "v_translations"

ALL = {
    "f9_residual_hangul": (f9, with_views("SELECT chunk_ix, round(CASE WHEN length(result) = 0 THEN 0 ELSE len(regexp_extract_all(result, '[가-힣]')) / length(result) END, 6) AS ratio, CASE WHEN length(result) = 0 THEN false ELSE len(regexp_extract_all(result, '[가-힣]')) / length(result) > 0.05 END AS residual FROM v_translations", V)),
    "f10_untranslated_echo": (f10, with_views("SELECT chunk_ix, regexp_replace(original, '^\\s+|\\s+$', '', 'g') = regexp_replace(result, '^\\s+|\\s+$', '', 'g') AND len(regexp_extract_all(original, '[A-Za-z]')) >= 20 AS echo FROM v_translations", V)),
    "f11_chunk_failed": (f11, with_views(f"WITH {FAILED} SELECT path, chunk_ix, lang, failed FROM fl", V)),
    "f12_cell_needs": (f12, with_views("SELECT chunk_ix, CASE WHEN lang = 'ko' THEN regexp_matches(result, '[A-Za-z]') ELSE regexp_matches(result, '[가-힣]') END AS needs FROM v_translations", V)),
    "f13_cell_hallucination": (f13, with_views("SELECT chunk_ix, contains(result, chr(10)) OR length(result) > 4 * length(original) + 40 AS bad FROM v_translations", V)),
    "a14_outcomes": (a14, with_views(f"WITH {FAILED} SELECT path, count(*) FILTER (WHERE NOT failed) AS ok, count(*) FILTER (WHERE failed) AS fail, bool_or(failed) AS is_error FROM fl GROUP BY path", V)),
    "a17_incomplete_summary": (a17, with_views(f"WITH {FAILED} SELECT path, string_agg(n::VARCHAR, ',' ORDER BY n) AS chunks, count(*) AS n_failed FROM nf WHERE failed GROUP BY path", V)),
    "sc18_markers": (sc18, with_views(f"WITH {FAILED} SELECT path, array_to_string(inc, ',') AS incomplete, total_chunks, true AS no_chunks FROM marks WHERE len(inc) > 0", V)),
    "t1_resume_action": (t1, with_views(f"WITH {FAILED} SELECT path, CASE WHEN total_chunks <= 3 OR k % 3 = 0 THEN 'full' WHEN len(inc) = 0 THEN 'skip' WHEN k % 4 <> 1 AND k % 5 <> 2 THEN 'retry' ELSE 'full' END AS action FROM marks", V)),
    "j13_chapter_marker": (j13, with_views(f"WITH {FAILED} SELECT pos, c.path, total_chunks FROM (SELECT pos, regexp_extract(path, '(src\\d+)\\.md$', 1) || '/' || (pos // 50) || '.md' AS path FROM v_chapters) c LEFT JOIN (SELECT * FROM marks WHERE len(inc) > 0) m ON m.path = c.path", V, "v_chapters")),
    "sk5_marker_merge": (sk5, with_views(f"WITH {FAILED} SELECT path, array_to_string(inc, ',') AS incomplete, CASE WHEN k % 3 <> 0 THEN total_chunks ELSE 1 END AS total_chunks FROM marks WHERE (k % 3 <> 0 AND len(inc) > 0) OR (k % 3 = 0 AND k % 2 = 0)", V)),
    "t5_last_write_wins": (t5, with_views("SELECT id, 3 AS seq, CASE WHEN (pos + 3) % 4 = 0 THEN 'deleted' ELSE 'edit' END AS op FROM v_sections", "v_sections")),
    "f14_is_table": (f14, with_views("SELECT chunk_ix, chunk_ix % 3 = 0 AS is_table FROM v_translations WHERE true", V)),
    "w17_chunk_packing": (w17, with_views("""WITH RECURSIVE p AS (SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY ln) AS i FROM v_lines WHERE trim(line) <> ''),
 walk AS (SELECT page, i, line, length(line) AS len, 0 AS ix FROM p WHERE i = 1 UNION ALL
  SELECT p.page, p.i, p.line, CASE WHEN w.len + 2 + length(p.line) <= 300 THEN w.len + 2 + length(p.line) ELSE length(p.line) END, CASE WHEN w.len + 2 + length(p.line) <= 300 THEN w.ix ELSE w.ix + 1 END FROM walk w JOIN p ON p.page = w.page AND p.i = w.i + 1)
 SELECT page, ix, md5(string_agg(line, chr(10) || chr(10) ORDER BY i)) AS digest, length(string_agg(line, chr(10) || chr(10) ORDER BY i))::INT AS n FROM walk GROUP BY page, ix""", "v_lines")),
    "x23_prompt": (x23, with_views(f"SELECT chunk_ix, md5('{T.PROMPT[0]}' || CASE lang WHEN 'en' THEN 'English' WHEN 'ko' THEN 'Korean' ELSE lang END || '{T.PROMPT[1]}' || chr(10) || chr(10) || original) AS digest FROM v_translations", V)),
    "x24_labels": (x24, with_views("SELECT chunk_ix, printf('[%d/%d] %s', row_number() OVER (PARTITION BY path ORDER BY chunk_ix), count(*) OVER (PARTITION BY path), path) AS label FROM v_translations", V)),
    "x25_first_line": (x25, with_views("SELECT chunk_ix, split_part(original, chr(10), 1) AS first_line FROM v_translations", V)),
    "f18_status": (f18, with_views("SELECT id, CASE op WHEN 'deleted' THEN 'deleted' WHEN 'edit' THEN 'modified' ELSE 'original' END AS status FROM v_sections", "v_sections")),
    "x21_title_edit": (x21, with_views("SELECT id, CASE WHEN pos % 2 = 0 THEN pos || '. ' ELSE '' END || new_title AS title FROM v_sections", "v_sections")),
    "j12_staged_edits": (j12, with_views("SELECT id, CASE WHEN op = 'edit' THEN pos || '. ' || new_title ELSE title END AS title, md5(CASE WHEN op = 'edit' THEN '+' || text ELSE text END) AS digest FROM v_sections WHERE op IS DISTINCT FROM 'deleted'", "v_sections")),
    "sk12_dead_links": (sk12, with_views("SELECT id, '#s' || ((pos * 7 + 3) % 1000) AS target, CASE WHEN (pos * 7 + 3) % 1000 IN (SELECT pos FROM v_sections WHERE op = 'deleted') THEN 'see' ELSE '<a href=\"#s' || ((pos * 7 + 3) % 1000) || '\">see</a>' END AS html FROM v_sections", "v_sections")),
    "j10_rank_matched": (j10, with_views("""WITH i AS (SELECT doc || '|' || src AS k, page, pos FROM v_images), e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page, pos) AS r FROM i), l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page DESC, pos DESC) AS r FROM i)
 SELECT k, e.page AS e_page, e.pos::INT AS e_pos, l.page AS l_page, l.pos::INT AS l_pos FROM e JOIN l USING (k, r)""", "v_images")),
    "j11_contained_first": (j11, with_views("SELECT n.pos AS needle_id, min(c.pos) AS text_id FROM v_chapters n JOIN v_chapters c ON contains(c.text, substr(n.text, 11, 40)) WHERE n.n_chars >= 60 GROUP BY n.pos", "v_chapters")),
    "w20_reinsertion": (w20, with_views("""WITH n AS (SELECT page AS id, ln AS ix, CASE WHEN ln % 3 = 1 THEN 'figure' WHEN ln % 5 = 4 THEN 'tip-box' ELSE 'content' END AS kind, md5(line) AS html FROM v_lines),
 f AS (SELECT page AS id, ln AS ix, row_number() OVER (PARTITION BY page ORDER BY ln) - 1 AS k FROM v_lines WHERE ln % 4 = 0), fn AS (SELECT id, count(*) AS n FROM f GROUP BY id),
 o AS (SELECT a.id, a.ix, a.html, least((SELECT count(*) FROM n b WHERE b.id = a.id AND b.ix < a.ix AND b.kind = 'content'), fn.n) AS k FROM n a JOIN fn USING (id) WHERE a.kind <> 'content')
 SELECT id, row_number() OVER (PARTITION BY id ORDER BY k, r, ix)::INT AS pos, html FROM (SELECT id, k, 0 AS r, ix, html FROM o UNION ALL SELECT id, k, 1, ix, 'new' FROM f)""", "v_lines")),
    "a15_change_summary": (a15, with_views("SELECT source, count(*) FILTER (WHERE pos % 7 = 0) AS n_image_delete, count(*) FILTER (WHERE pos % 7 = 1) AS n_image_replace, count(*) FILTER (WHERE pos % 7 = 2) AS n_image_add, count(*) FILTER (WHERE pos % 7 = 3) AS n_diagram_delete, count(*) FILTER (WHERE pos % 7 = 4) AS n_section_edit, count(*) FILTER (WHERE pos % 7 = 5) AS n_section_delete FROM v_sections GROUP BY source", "v_sections")),
    "f2_empty_guard": (f2, with_views("SELECT count(*) = 0 AS is_empty, count(*) AS n_chapters FROM v_chapters", "v_chapters")),
    "f17_tip_markers": (f17, with_views("SELECT page, ln::INT AS ln, starts_with(l, 'The') OR starts_with(l, 'A.') OR starts_with(l, '*') AS is_tip FROM (SELECT page, ln, ltrim(line) AS l FROM v_lines)", "v_lines")),
    "f21_highlight_classes": (f21, with_views("SELECT pos, ['language-python','language-bash','plain-code','plain-code','language-sh','language-css','plain-code'][pos % 7 + 1] AS html_class, ['language-python','language-bash','plain-code','language-dockerfile','language-sh','language-css','plain-code'][pos % 7 + 1] AS pdf_class FROM v_chapters", "v_chapters")),
    "m1_fit_math": (math, with_views("SELECT doc, page, pos::INT AS pos, round(s, 6) AS scale, ceil(round(height * s, 6))::BIGINT AS h, round_even(width * 0.25 * 2, 0) / 2 AS half FROM (SELECT *, least(1.0::DOUBLE, 40.0::DOUBLE / greatest(width, 1)) AS s FROM v_images)", "v_images")),
    "w19_visual_width": (width, with_views("SELECT chunk_ix, (length(s) + CASE WHEN chunk_ix % 2 = 0 THEN 4 ELSE 0 END + len(regexp_extract_all(original, '[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7a3}]')))::INT AS width FROM (SELECT chunk_ix, original, original || CASE WHEN chunk_ix % 2 = 0 THEN '한글漢字' ELSE '' END AS s FROM v_translations)", V)),
    "e1_toggle_element": (toggle, with_views("SELECT source, row_number() OVER (PARTITION BY source ORDER BY pos)::INT AS ix, CASE WHEN op = 'deleted' THEN 'active' ELSE 'deleted' END AS next FROM v_sections", "v_sections")),
    "x19_paragraph_repair": (x19, None),
}
