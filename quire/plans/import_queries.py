"""Queries that compose the page operators: words to texts of pages, and to imported documents, with the SQL of the page texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import page_import as P
from ..operators.layout import KEYS
from ..operators.paragraphs import CODE, CODE_END, HEADING
from ..session import table, written_dealt
from .layout_queries import ALIGNED, BANDS, BODY, COLS, GROUPS, HEADS, STATS, clusters
from .views import parts_of, v_words, with_views

HEIGHT = 1000.0


def _words(spark, d):
    """(pages, words): all pages of all documents, one without words having a page of its own; words gathered by page."""
    documents = table(spark, d, "documents")
    words = written_dealt(P.gathered(v_words(spark, d).select(*P.WORD)), KEYS, parts_of(documents))
    empty = documents.select("doc_id", F.lit(0).alias("page"))
    pages = words.select("doc_id", "page").unionByName(empty).distinct().withColumn("height", F.lit(HEIGHT))
    return pages, words


def sc11(spark, d):
    return P.page_texts(*_words(spark, d)).select("doc_id", "page", F.md5("text").alias("digest"))


def u4(spark, d):
    """What stands before, in and after the table of a page."""
    texts = P.region_texts(P.gathered(v_words(spark, d).select(*P.WORD)))
    return texts.select("doc_id", "page", "region", "col", F.md5("text").alias("digest"))


def sk8(spark, d):
    """Documents imported from their words, with their configuration."""
    return P.imported(*_words(spark, d)).select("doc_id", "path", "kind", F.md5("content").alias("digest"))


REGION = "doc_id, page, region"
_TABLE = f"""tw AS (SELECT * FROM vr WHERE region = 1), {GROUPS.replace('groups AS', 'tgroups AS').replace('FROM v_words', 'FROM tw')}, {clusters('tcols', 'tgroups', '10')},
 tplaced AS (SELECT doc_id, page, row, t, x0, replace(text, '|', '\\|') AS text, arg_min(cluster, (abs(x0 - center), cluster)) AS col FROM tw JOIN tcols USING (doc_id, page) GROUP BY ALL),
 cells AS (SELECT doc_id, page, row, col, string_agg(text, ' ' ORDER BY x0, t) AS cell FROM tplaced GROUP BY ALL),
 widths AS (SELECT c.doc_id, c.page, c.cluster AS col, greatest(1, coalesce(max(length(cell)), 1)) AS w FROM tcols c LEFT JOIN cells x ON x.doc_id = c.doc_id AND x.page = c.page AND x.col = c.cluster GROUP BY ALL),
 grid AS (SELECT r.doc_id, r.page, r.row, w.col, rpad(coalesce(cell, ''), w.w::INT, ' ') AS cell, repeat('-', w.w) AS dash FROM (SELECT DISTINCT doc_id, page, row FROM tw) r JOIN widths w USING (doc_id, page) LEFT JOIN cells x ON x.doc_id = r.doc_id AND x.page = r.page AND x.row = r.row AND x.col = w.col),
 tlines AS (SELECT doc_id, page, row, '| ' || string_agg(cell, ' | ' ORDER BY col) || ' |' AS line, '| ' || string_agg(dash, ' | ' ORDER BY col) || ' |' AS dash FROM grid GROUP BY ALL),
 tmd AS (SELECT doc_id, page, 1 AS region, 0 AS col, string_agg(line, chr(10) ORDER BY row, k) AS text FROM (SELECT doc_id, page, row, 0 AS k, line FROM tlines UNION ALL SELECT doc_id, page, min(row), 1, any_value(dash) FROM tlines GROUP BY doc_id, page) GROUP BY ALL)"""
_PROSE = f"""vx AS (SELECT * FROM vr WHERE region <> 1), {BANDS.replace('doc_id, page', REGION).replace('FROM v_words', 'FROM vx')},
 cp AS (SELECT vx.doc_id, vx.page, vx.region, t, row, x0, text, fontname, coalesce(min(CASE WHEN lo <= (x0 + x1) / 2 AND (x0 + x1) / 2 <= hi THEN ix END), arg_min(ix, (least(abs((x0 + x1) / 2 - lo), abs((x0 + x1) / 2 - hi)), ix))) AS col
  FROM vx JOIN bands USING ({REGION}) GROUP BY ALL),
 cl AS (SELECT {REGION}, col, row, string_agg(text, ' ' ORDER BY x0, t) AS line, bool_and(coalesce(regexp_matches(fontname, '(?i)courier|consolas|mono'), false)) AS is_code FROM cp GROUP BY {REGION}, col, row),
 ci AS (SELECT *, row_number() OVER (PARTITION BY {REGION}, col ORDER BY row) - row_number() OVER (PARTITION BY {REGION}, col, is_code ORDER BY row) AS k FROM cl),
 cr AS (SELECT *, count(*) OVER p AS n, row = min(row) OVER p AS f, row = max(row) OVER p AS l FROM ci WINDOW p AS (PARTITION BY {REGION}, col, is_code, k)),
 cmd AS (SELECT {REGION}, col, string_agg(CASE WHEN is_code AND n >= 2 AND f THEN '{CODE}' || chr(10) ELSE '' END || line || CASE WHEN is_code AND n >= 2 AND l THEN chr(10) || '{CODE_END}' ELSE '' END, chr(10) ORDER BY row) AS text FROM cr GROUP BY {REGION}, col)"""
_RUNS = """ix AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY row) - 1 AS ix FROM aligned),
 runs AS (SELECT doc_id, page, min(ix) AS s, max(ix) + 1 AS e FROM (SELECT *, ix - row_number() OVER (PARTITION BY doc_id, page ORDER BY ix) AS k FROM ix WHERE aligned >= 3 AND n_cols >= 3) GROUP BY doc_id, page, k),
 tb AS (SELECT doc_id, page, s, e FROM runs WHERE e - s >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY e - s DESC, s) = 1)"""
_DENSE = "SELECT * REPLACE ((dense_rank() OVER (PARTITION BY doc_id, page ORDER BY row) - 1)::INT AS row) FROM v_words"


def _regions(words: str) -> str:
    """From words in rows to texts of regions."""
    return f"{COLS.replace('FROM v_words', f'FROM {words}')}, {ALIGNED}, {_RUNS}, vr AS (SELECT w.*, CASE WHEN s IS NULL OR row < s THEN 0 WHEN row < e THEN 1 ELSE 2 END AS region FROM {words} w LEFT JOIN tb USING (doc_id, page)), {_TABLE}, {_PROSE}, alltext AS (SELECT * FROM tmd UNION ALL SELECT * FROM cmd)"


SC11 = f"""WITH vw AS ({_DENSE} WHERE NOT regexp_matches(text, '[\\x00-\\x1f\\x7f]')), {STATS.replace('FROM v_words', 'FROM vw')}, {BODY.replace('FROM v_words', 'FROM vw')}, {HEADS},
 ok AS (SELECT doc_id FROM (SELECT doc_id, count(*) AS n FROM stats GROUP BY doc_id) JOIN (SELECT doc_id, count(*) AS h FROM heads WHERE doc_id IN (SELECT doc_id FROM body WHERE body_size IS NOT NULL) GROUP BY doc_id) USING (doc_id) WHERE n < 50 OR h / n <= 0.05),
 vm AS (SELECT doc_id, page, row, t, text, x0, x1, fontname FROM vw UNION ALL SELECT doc_id, page, row, arg_min(t, (x0, t)), '{HEADING}', min(x0) - 1, min(x0) - 0.5, NULL FROM vw JOIN heads USING (doc_id, page, row) WHERE doc_id IN (SELECT doc_id FROM ok) GROUP BY doc_id, page, row),
 {_regions('vm')}, pt AS (SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY region, col) AS text FROM alltext WHERE text <> '' GROUP BY doc_id, page),
 pg AS (SELECT DISTINCT doc_id, page FROM v_words UNION SELECT doc_id, 0 FROM documents)
 SELECT pg.doc_id, pg.page, md5(coalesce(text, '')) AS digest FROM pg LEFT JOIN pt ON pt.doc_id = pg.doc_id AND pt.page = pg.page"""

ALL = {
    "sc11_page_texts": (sc11, with_views(SC11, "v_words")),
    "u4_around_tables": (u4, with_views(f"WITH vw AS ({_DENSE}), {_regions('vw')} SELECT doc_id, page, region, col::INT AS col, md5(text) AS digest FROM alltext", "v_words")),
    "sk8_imported_documents": (sk8, None),
}
