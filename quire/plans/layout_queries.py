"""Queries over positioned words, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from .views import v_words, with_views

GROUPS = """groups AS (SELECT doc_id, page, row, g, min(x0) AS x0, arg_max(x1, (x0, t)) AS x1, count(*) AS n_words FROM (
 SELECT *, sum(f) OVER (PARTITION BY doc_id, page, row ORDER BY x0, t) AS g FROM (
 SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, page, row ORDER BY x0, t) > 20 THEN 1 ELSE 0 END AS f FROM v_words)) GROUP BY ALL)"""


def clusters(name: str, source: str, tol: str) -> str:
    return f"""{name} AS (SELECT doc_id, page, cluster, avg(x0) AS center, count(*) AS n FROM (
 SELECT *, sum(f) OVER (PARTITION BY doc_id, page ORDER BY x0 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM (
 SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0) > {tol} THEN 1 ELSE 0 END AS f FROM {source})) GROUP BY ALL)"""


COLS = GROUPS + ",\n" + clusters("cols", "(SELECT * FROM groups QUALIFY count(*) OVER (PARTITION BY doc_id, page, row) >= 3)", "10")
ALIGNED = """aligned AS (SELECT g.doc_id, g.page, g.row, count(DISTINCT (SELECT min(c.cluster) FROM cols c WHERE c.doc_id = g.doc_id AND c.page = g.page AND abs(g.x0 - c.center) <= 10)) AS aligned,
 (SELECT count(*) FROM cols c WHERE c.doc_id = g.doc_id AND c.page = g.page) AS n_cols FROM groups g GROUP BY g.doc_id, g.page, g.row)"""
STATS = """stats AS (SELECT doc_id, page, row, count(*) AS n_words, min(top) AS top, max(bottom) AS bottom, max(size) - min(size) AS spread, avg(size) AS avg_size,
 bool_and(coalesce(regexp_matches(fontname, '(?i)courier|consolas|mono'), false)) AS is_code FROM v_words GROUP BY doc_id, page, row),
gapped AS (SELECT *, top - lag(bottom) OVER (PARTITION BY doc_id, page ORDER BY row) AS gap_before FROM stats)"""
BODY = """buckets AS (SELECT doc_id, round_even(size * 2, 0) / 2 AS bucket, count(*) AS n, min((page, t)) AS first FROM v_words GROUP BY ALL),
body AS (SELECT doc_id, CASE WHEN sum(n) >= 20 THEN arg_min(bucket, (-n, first)) END AS body_size FROM buckets GROUP BY doc_id),
hsizes AS (SELECT b.doc_id, b.bucket FROM buckets b JOIN body USING (doc_id) LEFT JOIN buckets m ON m.doc_id = b.doc_id AND m.bucket = body_size
 WHERE b.bucket >= 1.15 * body_size AND (m.n IS NULL OR b.n / m.n <= 0.15))"""
HEADS = """heads AS (SELECT g.doc_id, g.page, g.row FROM gapped g JOIN (SELECT doc_id, page, median(gap_before) AS m FROM gapped GROUP BY ALL) d USING (doc_id, page) JOIN body USING (doc_id)
 WHERE n_words <= 15 AND spread <= 0.5 AND (gap_before IS NULL OR m IS NULL OR gap_before >= m * 1.8)
 AND CASE WHEN EXISTS (SELECT 1 FROM hsizes h WHERE h.doc_id = g.doc_id) THEN EXISTS (SELECT 1 FROM hsizes h WHERE h.doc_id = g.doc_id AND h.bucket = round_even(avg_size * 2, 0) / 2) ELSE avg_size >= body_size * 1.15 END)"""
BANDS = """spans AS (SELECT doc_id, page, min(x0) AS lo, max(x1) AS hi, max(x1) - min(x0) AS span FROM v_words GROUP BY ALL),
bins AS (SELECT DISTINCT doc_id, page, unnest(range(greatest(0, floor((x0 - lo) / 2)::INT), least(greatest(1, floor(span / 2)::INT + 1) - 1, floor((x1 - lo) / 2)::INT) + 1)) AS b FROM v_words JOIN spans USING (doc_id, page)),
holes AS (SELECT *, lead(b) OVER (PARTITION BY doc_id, page ORDER BY b) AS nb FROM bins),
cuts AS (SELECT doc_id, page, ((lo + (b + 1) * 2) + (lo + nb * 2)) / 2 AS cut FROM holes JOIN spans USING (doc_id, page)
 WHERE nb - b - 1 >= greatest(2, floor(span * 0.02 / 2)::INT, 7) AND (((lo + (b + 1) * 2) + (lo + nb * 2)) / 2 - lo) / span > 0.1 AND (((lo + (b + 1) * 2) + (lo + nb * 2)) / 2 - lo) / span < 0.9),
edges AS (SELECT doc_id, page, lo AS e FROM spans UNION ALL SELECT doc_id, page, cut FROM cuts UNION ALL SELECT doc_id, page, hi FROM spans),
bands AS (SELECT doc_id, page, ix::INT AS ix, lo, hi FROM (SELECT doc_id, page, e AS lo, lead(e) OVER w AS hi, row_number() OVER w - 1 AS ix FROM edges WINDOW w AS (PARTITION BY doc_id, page ORDER BY e)) WHERE hi IS NOT NULL)"""


def w6(spark, d):
    return L.anchored_rows(v_words(spark, d)).select("doc_id", "page", "t", "row_ix", F.col("word_ix").cast("int").alias("word_ix"))


def w7(spark, d):
    return L.row_groups(v_words(spark, d))


def a10(spark, d):
    c = L.chain_clusters(v_words(spark, d), L.KEYS, "x0", 10.0)
    return c.select("doc_id", "page", "cluster", F.round("center", 4).alias("center"), "n")


def w8(spark, d):
    return L.chain_clusters(v_words(spark, d), L.KEYS, "x0", 10.0).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_clusters"))


def a18(spark, d):
    g = L.row_groups(v_words(spark, d))
    return L.aligned_counts(g, L.global_columns(g)).select("doc_id", "page", "row", "aligned")


def w10(spark, d):
    return L.table_runs(v_words(spark, d))


def w11(spark, d):
    return L.column_bands(v_words(spark, d)).select("doc_id", "page", "ix", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def j7(spark, d):
    w = v_words(spark, d)
    return L.assign_columns(w, L.column_bands(w)).select("doc_id", "page", "t", "col")


def s4(spark, d):
    w = v_words(spark, d)
    placed = L.assign_columns(w, L.column_bands(w))
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id", "page").orderBy("col", "row", "x0", "t")
    return placed.select("doc_id", "page", "t", F.row_number().over(order).alias("read_ix"))


def j8(spark, d):
    w = v_words(spark, d)
    cols = L.chain_clusters(L.row_groups(w), L.KEYS, "x0", 10.0)
    lists = cols.groupBy(*L.KEYS).agg(F.collect_list(F.struct("cluster", "center")).alias("cols"))
    far = F.array_min(F.transform("cols", lambda c: F.struct(F.round(F.abs(F.col("x0") - c.center), 6).alias("d"), c.cluster.alias("cluster"))))
    return w.join(lists, L.KEYS).select("doc_id", "page", "t", far["cluster"].alias("col"))


def j9(spark, d):
    g = L.row_groups(v_words(spark, d))
    cols = L.global_columns(g).select("doc_id", "page", "cluster", "center")
    hit = g.join(cols, L.KEYS).filter(F.abs(F.col("x0") - F.col("center")) <= 10)
    return hit.groupBy("doc_id", "page", "row", "g").agg(F.min("cluster").alias("col"))


def x20(spark, d):
    return L.table_markdown(v_words(spark, d))


def a11(spark, d):
    w = v_words(spark, d)
    col = F.when(F.col("doc_id") % 3 == 0, F.col("t") % 3).when(F.col("doc_id") % 3 == 1, F.col("t") % 4).otherwise(F.col("t") % 8)
    return w.groupBy("doc_id", col.alias("col")).agg(F.greatest(F.lit(1), F.max(F.length("text"))).alias("width"))


def w12(spark, d):
    return L.rows_text(v_words(spark, d))


def w13(spark, d):
    return L.row_gaps(L.row_stats(v_words(spark, d))).select("doc_id", "page", "row", "gap_before")


def a9(spark, d):
    return L.row_stats(v_words(spark, d)).select("doc_id", "page", "row", "n_words", "top", "bottom", F.round("spread", 4).alias("spread"), F.round("avg_size", 4).alias("avg_size"))


def f7(spark, d):
    return L.row_stats(v_words(spark, d)).select("doc_id", "page", "row", "is_code")


def a8(spark, d):
    g = L.row_gaps(L.row_stats(v_words(spark, d)))
    return g.groupBy("doc_id", "page").agg(F.median("gap_before").alias("median_gap"))


def a5(spark, d):
    return L.body_size(v_words(spark, d))


def a6(spark, d):
    w = v_words(spark, d)
    return L.heading_sizes(w, L.body_size(w))


def _heads(spark, d):
    w = v_words(spark, d)
    bodies = L.body_size(w)
    return w, L.heading_rows(w, bodies, L.heading_sizes(w, bodies))


def f5(spark, d):
    return _heads(spark, d)[1]


def f6(spark, d):
    w, h = _heads(spark, d)
    return L.heading_sanity(h, L.row_stats(w))


def a12(spark, d):
    w, h = _heads(spark, d)
    s = L.heading_sanity(h, L.row_stats(w))
    return s.agg(F.sum("n_headings").alias("n_headings"), F.sum("n_rows").alias("n_rows"), F.count_if(~F.col("sane")).alias("n_vetoed"))


def _level(spark, d):
    """Words whose tops don't waver within a row."""
    return v_words(spark, d).withColumn("top", F.col("top") - F.col("t") % 3)


def w14(spark, d):
    return L.char_gaps(_level(spark, d)).select("doc_id", "page", F.round("gap", 4).alias("gap"))


def a7(spark, d):
    return L.word_tolerance(L.char_gaps(_level(spark, d)))


def s9(spark, d):
    return v_words(spark, d).filter("page < 10").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"))


def f3(spark, d):
    w = v_words(spark, d).withColumn("text", F.when(F.col("t") % 11 == 0, F.concat("text", F.lit("\x01"))).otherwise(F.col("text")))
    return L.garbled_free(w).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_words"))


def f4(spark, d):
    numbered = v_words(spark, d).withColumn("text", F.when(F.col("row").isin(0, 39), (F.col("t") % 12000).cast("string")).otherwise(F.col("text")))
    return L.page_number_words(numbered, 1000.0).select("doc_id", "page", "t", "text")


def u2(spark, d):
    w, h = _heads(spark, d)
    first = w.join(h, ["doc_id", "page", "row"]).groupBy("doc_id", "page", "row").agg(F.min_by(F.struct("t", "x0", "top"), F.struct("x0", "t")).alias("f"))
    marks = first.select("doc_id", "page", F.col("f.t").alias("t"), F.lit("##").alias("text"), (F.col("f.x0") - 1).alias("x0"), F.col("f.top").alias("top"))
    return w.select("doc_id", "page", "t", "text", "x0", "top").unionByName(marks)


ALL = {
    "w6_anchored_rows": (w6, with_views("""SELECT doc_id, page, t, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY row) - 1)::INT AS row_ix,
 (row_number() OVER (PARTITION BY doc_id, page, row ORDER BY x0, t) - 1)::INT AS word_ix FROM v_words""", "v_words")),
    "w7_row_groups": (w7, with_views(f"WITH {GROUPS} SELECT doc_id, page, row, g::INT AS g, x0, x1, n_words FROM groups", "v_words")),
    "w8_chain_clusters": (w8, with_views(f"WITH {clusters('c', 'v_words', '10')} SELECT doc_id, page, count(*) AS n_clusters FROM c GROUP BY ALL", "v_words")),
    "a10_cluster_means": (a10, with_views(f"WITH {clusters('c', 'v_words', '10')} SELECT doc_id, page, cluster::INT AS cluster, round(center, 4) AS center, n FROM c", "v_words")),
    "a18_aligned_count": (a18, with_views(f"WITH {COLS}, {ALIGNED} SELECT doc_id, page, row, aligned FROM aligned", "v_words")),
    "w10_table_runs": (w10, with_views(f"""WITH {COLS}, {ALIGNED}, ix AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY row) - 1 AS ix FROM aligned),
 runs AS (SELECT doc_id, page, min(ix) AS s, max(ix) + 1 AS e FROM (SELECT *, ix - row_number() OVER (PARTITION BY doc_id, page ORDER BY ix) AS k FROM ix WHERE aligned >= 3 AND n_cols >= 3) GROUP BY doc_id, page, k)
 SELECT doc_id, page, s::INT AS start_row, e::INT AS end_row FROM runs WHERE e - s >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY e - s DESC, s) = 1""", "v_words")),
    "w11_column_bands": (w11, with_views(f"WITH {BANDS} SELECT doc_id, page, ix, round(lo, 4) AS lo, round(hi, 4) AS hi FROM bands", "v_words")),
    "j7_word_column": (j7, with_views(f"""WITH {BANDS} SELECT doc_id, page, t, coalesce(min(CASE WHEN lo <= (x0 + x1) / 2 AND (x0 + x1) / 2 <= hi THEN ix END),
 arg_min(ix, (least(abs((x0 + x1) / 2 - lo), abs((x0 + x1) / 2 - hi)), ix))) AS col FROM v_words JOIN bands USING (doc_id, page) GROUP BY doc_id, page, t""", "v_words")),
    "s4_reading_order": (s4, with_views(f"""WITH {BANDS}, placed AS (SELECT doc_id, page, t, row, x0, coalesce(min(CASE WHEN lo <= (x0 + x1) / 2 AND (x0 + x1) / 2 <= hi THEN ix END),
 arg_min(ix, (least(abs((x0 + x1) / 2 - lo), abs((x0 + x1) / 2 - hi)), ix))) AS col FROM v_words JOIN bands USING (doc_id, page) GROUP BY doc_id, page, t, row, x0)
 SELECT doc_id, page, t, row_number() OVER (PARTITION BY doc_id, page ORDER BY col, row, x0, t)::INT AS read_ix FROM placed""", "v_words")),
    "j8_nearest_table_column": (j8, with_views(f"""WITH {GROUPS}, {clusters('cols', 'groups', '10')} SELECT doc_id, page, t, arg_min(cluster, (round(abs(x0 - center), 6), cluster))::INT AS col
 FROM v_words JOIN cols USING (doc_id, page) GROUP BY doc_id, page, t""", "v_words")),
    "j9_band_join": (j9, with_views(f"WITH {COLS} SELECT g.doc_id, g.page, g.row, g.g::INT AS g, min(cluster)::INT AS col FROM groups g JOIN cols c ON c.doc_id = g.doc_id AND c.page = g.page AND abs(g.x0 - center) <= 10 GROUP BY ALL", "v_words")),
    "x20_table_markdown": (x20, with_views(f"""WITH tw AS (SELECT * FROM v_words), {GROUPS.replace('FROM v_words', 'FROM tw')}, {clusters('cols', 'groups', '10')},
 placed AS (SELECT doc_id, page, row, t, x0, replace(text, '|', '\\|') AS text, arg_min(cluster, (abs(x0 - center), cluster)) AS col FROM tw JOIN cols USING (doc_id, page) GROUP BY ALL),
 cells AS (SELECT doc_id, page, row, col, string_agg(text, ' ' ORDER BY x0, t) AS cell FROM placed GROUP BY ALL),
 widths AS (SELECT c.doc_id, c.page, c.cluster AS col, greatest(1, coalesce(max(length(cell)), 1)) AS w FROM cols c LEFT JOIN cells x ON x.doc_id = c.doc_id AND x.page = c.page AND x.col = c.cluster GROUP BY ALL),
 grid AS (SELECT r.doc_id, r.page, r.row, w.col, rpad(coalesce(cell, ''), w.w::INT, ' ') AS cell, repeat('-', w.w) AS dash FROM (SELECT DISTINCT doc_id, page, row FROM tw) r JOIN widths w USING (doc_id, page) LEFT JOIN cells x ON x.doc_id = r.doc_id AND x.page = r.page AND x.row = r.row AND x.col = w.col),
 lines AS (SELECT doc_id, page, row, '| ' || string_agg(cell, ' | ' ORDER BY col) || ' |' AS line, '| ' || string_agg(dash, ' | ' ORDER BY col) || ' |' AS dash FROM grid GROUP BY ALL)
 SELECT doc_id, page, string_agg(line, chr(10) ORDER BY row, k) AS table_md FROM (SELECT doc_id, page, row, 0 AS k, line FROM lines UNION ALL SELECT doc_id, page, min(row), 1, any_value(dash) FROM lines GROUP BY doc_id, page) GROUP BY ALL""", "v_words")),
    "a11_column_widths": (a11, with_views("SELECT doc_id, (CASE doc_id % 3 WHEN 0 THEN t % 3 WHEN 1 THEN t % 4 ELSE t % 8 END)::INT AS col, greatest(1, max(length(text)))::INT AS width FROM v_words GROUP BY ALL", "v_words")),
    "w12_code_runs": (w12, with_views(f"""WITH {STATS}, lines AS (SELECT doc_id, page, row, string_agg(text, ' ' ORDER BY x0, t) AS line FROM v_words GROUP BY ALL),
 isl AS (SELECT s.doc_id, s.page, s.row, is_code, line, row_number() OVER (PARTITION BY s.doc_id, s.page ORDER BY s.row) - row_number() OVER (PARTITION BY s.doc_id, s.page, is_code ORDER BY s.row) AS k FROM stats s JOIN lines USING (doc_id, page, row)),
 runs AS (SELECT *, count(*) OVER p AS n, row = min(row) OVER p AS f, row = max(row) OVER p AS l FROM isl WINDOW p AS (PARTITION BY doc_id, page, is_code, k))
 SELECT doc_id, page, string_agg(CASE WHEN is_code AND n >= 2 AND f THEN '```' || chr(10) ELSE '' END || line || CASE WHEN is_code AND n >= 2 AND l THEN chr(10) || '```' ELSE '' END, chr(10) ORDER BY row) AS text FROM runs GROUP BY ALL""", "v_words")),
    "w13_row_gap": (w13, with_views(f"WITH {STATS} SELECT doc_id, page, row, gap_before FROM gapped", "v_words")),
    "a9_row_stats": (a9, with_views(f"WITH {STATS} SELECT doc_id, page, row, n_words, top, bottom, round(spread, 4) AS spread, round(avg_size, 4) AS avg_size FROM stats", "v_words")),
    "f7_code_rows": (f7, with_views(f"WITH {STATS} SELECT doc_id, page, row, is_code FROM stats", "v_words")),
    "a8_median_row_gap": (a8, with_views(f"WITH {STATS} SELECT doc_id, page, median(gap_before) AS median_gap FROM gapped GROUP BY ALL", "v_words")),
    "a5_body_font_size": (a5, with_views(f"WITH {BODY} SELECT doc_id, body_size FROM body", "v_words")),
    "a6_heading_sizes": (a6, with_views(f"WITH {BODY} SELECT doc_id, bucket FROM hsizes", "v_words")),
    "f5_heading_rows": (f5, with_views(f"WITH {STATS}, {BODY}, {HEADS} SELECT doc_id, page, row FROM heads", "v_words")),
    "f6_heading_sanity": (f6, with_views(f"""WITH {STATS}, {BODY}, {HEADS} SELECT doc_id, coalesce(h, 0) AS n_headings, n AS n_rows, n < 50 OR coalesce(h, 0) / n <= 0.05 AS sane
 FROM (SELECT doc_id, count(*) AS n FROM stats GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS h FROM heads GROUP BY doc_id) USING (doc_id)""", "v_words")),
    "a12_document_totals": (a12, with_views(f"""WITH {STATS}, {BODY}, {HEADS} SELECT sum(coalesce(h, 0))::BIGINT AS n_headings, sum(n)::BIGINT AS n_rows, count(*) FILTER (WHERE NOT (n < 50 OR coalesce(h, 0) / n <= 0.05)) AS n_vetoed
 FROM (SELECT doc_id, count(*) AS n FROM stats GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS h FROM heads GROUP BY doc_id) USING (doc_id)""", "v_words")),
    "w14_char_gaps": (w14, with_views("""SELECT doc_id, page, round(gap, 4) AS gap FROM (SELECT doc_id, page, CASE WHEN abs(top - t % 3 - lag(top - t % 3) OVER w) < 1 THEN x0 - lag(x1) OVER w END AS gap FROM v_words WHERE page < 10
 WINDOW w AS (PARTITION BY doc_id, page ORDER BY round(top - t % 3, 1), x0)) WHERE gap >= 0 AND gap < 20""", "v_words")),
    "a7_word_tolerance": (a7, with_views("""WITH gaps AS (SELECT doc_id, gap FROM (SELECT doc_id, page, CASE WHEN abs(top - t % 3 - lag(top - t % 3) OVER w) < 1 THEN x0 - lag(x1) OVER w END AS gap FROM v_words WHERE page < 10
 WINDOW w AS (PARTITION BY doc_id, page ORDER BY round(top - t % 3, 1), x0)) WHERE gap >= 0 AND gap < 20),
 nexts AS (SELECT *, lead(gap) OVER (PARTITION BY doc_id ORDER BY gap) AS nx FROM gaps)
 SELECT doc_id, CASE WHEN count(*) >= 20 AND count(*) FILTER (WHERE nx - gap >= 0.5) > 0 THEN greatest(1.0::DOUBLE, least(3.0::DOUBLE, arg_min((gap + nx) / 2, gap) FILTER (WHERE nx - gap >= 0.5))) ELSE 3.0::DOUBLE END AS tolerance FROM nexts GROUP BY doc_id""", "v_words")),
    "s9_page_sample": (s9, with_views("SELECT doc_id, count(*) AS n_words FROM v_words WHERE page < 10 GROUP BY ALL", "v_words")),
    "f3_garbled_words": (f3, with_views("SELECT doc_id, page, count(*) AS n_words FROM v_words WHERE t % 11 <> 0 GROUP BY ALL", "v_words")),
    "f4_page_numbers": (f4, with_views("""WITH n AS (SELECT doc_id, page, row, t, top, bottom, CASE WHEN row IN (0, 39) THEN (t % 12000)::VARCHAR ELSE text END AS text FROM v_words)
 SELECT doc_id, page, t, text FROM n QUALIFY NOT (count(*) OVER (PARTITION BY doc_id, page, row) = 1 AND regexp_full_match(text, '[0-9]{1,4}') AND (top < 100 OR bottom > 900))""", "v_words")),
    "u2_heading_markers": (u2, with_views(f"""WITH {STATS}, {BODY}, {HEADS} SELECT doc_id, page, t, text, x0, top FROM v_words UNION ALL
 SELECT doc_id, page, arg_min(t, (x0, t)), '##', min(x0) - 1, arg_min(top, (x0, t)) FROM v_words JOIN heads USING (doc_id, page, row) GROUP BY doc_id, page, row""", "v_words")),
}
