"""Input views: structure that the supplied tables lack, derived the same way in Spark and in DuckDB.

Each view is a function of (spark, sf_dir), and a common table expression of the same name in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def v_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document: doc (the source), page (doc_id), ln, line."""
    return table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("ln", "line"))


def v_chapters(spark: SparkSession, d: str) -> DataFrame:
    """A corpus tree: parts with Roman numerals, front and back matter, an appendix, other folders."""
    i = F.col("doc_id")
    number = F.when(i % 2 == 0, F.lpad((i % 30).cast("string"), 2, "0")).otherwise((i % 30).cast("string"))
    part = F.element_at(F.array(*map(F.lit, ("I", "II", "IV", "X"))), (i % 4 + 1).cast("int"))
    stem = F.concat(F.lit("_"), F.col("source"), F.lit(".md"))
    path = (
        F.when(i % 10 == 0, F.concat(F.lpad((i % 100).cast("string"), 2, "0"), F.lit("_top"), stem))
        .when(i % 13 == 0, F.concat(F.lit("Appendix/A"), i.cast("string"), stem))
        .when(i % 17 == 0, F.concat(F.lit("notes/n"), i.cast("string"), stem))
        .otherwise(F.concat(F.lit("Part_"), part, F.lit("_some_name/Chapter_"), number, stem))
    )
    title = F.regexp_extract("text", "([^\\s]+)", 1)
    label = F.when(i % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("Part "), part))
    return table(spark, d, "documents").select(i.alias("pos"), path.alias("path"), title.alias("title"), label.alias("part_label"), "text", F.length("text").alias("n_chars"))


def v_words(spark: SparkSession, d: str) -> DataFrame:
    """Positioned words of whole texts: 40 rows a page, in three layouts (table, two columns, prose).

    Texts are dealt by page once, as text, and words are made behind that exchange: windows, groupings and
    joins within pages find the rows of a page together and deal them no further.
    """
    kind = F.col("doc_id") % 3
    n = F.when(kind == 0, 3).when(kind == 1, 4).otherwise(8)
    documents = table(spark, d, "documents")
    # a split is one pass over the text; regexp_extract_all copies the text for each match
    text = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    words = documents.filter(text != "").select("doc_id", F.split(text, "\\s+").alias("words"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / (40 * n)).cast("int")), lambda p: F.array_join(F.slice("words", p * 40 * n + 1, 40 * n), " "))
    dealt = words.select("doc_id", F.posexplode(pages).alias("page", "words")).repartition(parts_of(documents), "doc_id", "page").withColumn("words", F.split("words", " "))
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / n).cast("int")), lambda r: F.slice("words", r * n + 1, n))
    w = dealt.select("doc_id", "page", F.posexplode(rows).alias("row", "words")).select("doc_id", "page", "row", "words", F.posexplode("words").alias("col", "text"))
    w = w.withColumn("t", (F.col("page") * 40 * n + F.col("row") * n + F.col("col")).cast("int"))
    offset = F.when(F.col("col") > 0, F.length(F.array_join(F.slice("words", F.lit(1), F.col("col")), " ")) + 1).otherwise(0)
    x0 = F.when(kind == 0, 72 + 180 * F.col("col")).when(kind == 1, 72 + 78 * (F.col("col") % 2) + 330 * F.floor(F.col("col") / 2)).otherwise(72 + 6 * offset)
    w = w.withColumn("x0", x0.cast("double")).withColumn("x1", F.col("x0") + 6 * F.length("text"))
    w = w.withColumn("top", (100 + 20 * F.col("row") + F.col("t") % 3).cast("double")).withColumn("bottom", F.col("top") + 12)
    size = F.when((F.col("row") == 0) & (F.col("page") == 0), 20.0).otherwise(11.0 + (F.col("doc_id") % 3) * 0.05)
    font = F.when((F.col("doc_id") + F.col("row")) % 7 < 2, F.lit("CourierNewPSMT")).otherwise(F.lit("Times-Roman"))
    return w.select("doc_id", "page", "row", "t", "text", "x0", "x1", "top", "bottom", size.alias("size"), font.alias("fontname"))


def parts_of(documents: DataFrame) -> int:
    """Partitions for words, which take many times the room of their texts: some for each split of the input, so that a task's share stays."""
    return max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * documents.rdd.getNumPartitions())


def v_bands(spark: SparkSession, d: str) -> DataFrame:
    """Vertical bands by order."""
    y0 = F.floor("l_extendedprice").cast("long") % 1000
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), y0.alias("y0"), (y0 + F.floor("l_quantity").cast("long")).alias("y1"))


def v_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", "html")


def v_translations(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a result: echoes, blank-trimmed echoes, mixtures and residues of Hangul."""
    i, t = F.col("doc_id"), F.col("text")
    result = F.when(i % 4 == 0, t).when(i % 4 == 1, F.concat(F.lit("  "), t, F.lit("\n"))).when(i % 4 == 2, F.concat(F.lit("한글 번역 "), t)).otherwise(F.concat(F.lit("한국어"), F.substring(t, 1, 20)))
    lang = F.element_at(F.array(*map(F.lit, ("en", "ko", "fr"))), (F.floor(i / 4) % 3 + 1).cast("int"))
    return table(spark, d, "documents").select(F.concat(F.col("source"), F.lit("/"), F.floor(i / 50).cast("long").cast("string"), F.lit(".md")).alias("path"), i.alias("chunk_ix"), t.alias("original"), result.alias("result"), lang.alias("lang"))


def v_images(spark: SparkSession, d: str) -> DataFrame:
    """One image per line: hash, file, size and place."""
    h = F.md5("line")
    return v_lines(spark, d).select("doc", "page", F.col("ln").alias("pos"), h.alias("hash"), F.concat(F.lit("images/page_"), (F.col("page") % 40).cast("string"), F.lit("_"), F.substring(h, 1, 2), F.lit(".png")).alias("src"), (F.length("line") % 60).cast("double").alias("width"), ((F.col("page") + F.col("ln")) % 50).cast("double").alias("height"))


def v_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of an edited book, with what is staged for them."""
    i = F.col("doc_id")
    op = F.when(i % 5 == 0, F.lit("deleted")).when(i % 5 == 1, F.lit("edit"))
    title = F.concat(i.cast("string"), F.lit(". "), F.regexp_extract("text", "([^\\s]+)", 1))
    return table(spark, d, "documents").select(F.concat(F.lit("s"), i.cast("string")).alias("id"), i.alias("pos"), title.alias("title"), "text", op.alias("op"), F.concat(F.lit("New "), F.regexp_extract("text", "([^\\s]+)", 1)).alias("new_title"), "source")


SQL = {
    "v_lines": "SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents",
    "v_chapters": """SELECT doc_id AS pos, CASE WHEN doc_id % 10 = 0 THEN lpad((doc_id % 100)::VARCHAR, 2, '0') || '_top_' || source || '.md'
   WHEN doc_id % 13 = 0 THEN 'Appendix/A' || doc_id || '_' || source || '.md' WHEN doc_id % 17 = 0 THEN 'notes/n' || doc_id || '_' || source || '.md'
   ELSE 'Part_' || ['I','II','IV','X'][doc_id % 4 + 1] || '_some_name/Chapter_' || CASE WHEN doc_id % 2 = 0 THEN lpad((doc_id % 30)::VARCHAR, 2, '0') ELSE (doc_id % 30)::VARCHAR END || '_' || source || '.md' END AS path,
   regexp_extract(text, '([^\\s]+)', 1) AS title, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'Part ' || ['I','II','IV','X'][doc_id % 4 + 1] END AS part_label, text, length(text) AS n_chars FROM documents""",
    "v_words": """SELECT doc_id, (r // 40)::INT AS page, (r % 40)::INT AS row, t::INT AS t, text, x0, x0 + 6 * length(text) AS x1, (100 + 20 * (r % 40) + t % 3)::DOUBLE AS top, (112 + 20 * (r % 40) + t % 3)::DOUBLE AS bottom,
   CASE WHEN r = 0 THEN 20.0::DOUBLE ELSE 11.0::DOUBLE + (doc_id % 3) * 0.05::DOUBLE END AS size, CASE WHEN (doc_id + r % 40) % 7 < 2 THEN 'CourierNewPSMT' ELSE 'Times-Roman' END AS fontname
   FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 72 + 180 * c WHEN 1 THEN 72 + 78 * (c % 2) + 330 * (c // 2) ELSE 72 + 6 * coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, r ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::DOUBLE AS x0
   FROM (SELECT *, t // n AS r, t % n AS c FROM (SELECT doc_id, unnest(k) AS text, generate_subscripts(k, 1) - 1 AS t, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 8 END AS n
   FROM (SELECT doc_id, regexp_extract_all(text, '[^\\s]+') AS k FROM documents))))""",
    "v_bands": "SELECT l_orderkey AS id, floor(l_extendedprice)::BIGINT % 1000 AS y0, floor(l_extendedprice)::BIGINT % 1000 + floor(l_quantity)::BIGINT AS y1 FROM lineitem",
    "v_html": "SELECT page_id, url, html FROM pages",
    "v_translations": """SELECT source || '/' || (doc_id // 50) || '.md' AS path, doc_id AS chunk_ix, text AS original, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '  ' || text || chr(10)
   WHEN 2 THEN '한글 번역 ' || text ELSE '한국어' || substr(text, 1, 20) END AS result, ['en','ko','fr'][(doc_id // 4) % 3 + 1] AS lang FROM documents""",
    "v_images": """SELECT doc, page, ln::INT AS pos, md5(line) AS hash, 'images/page_' || (page % 40) || '_' || substr(md5(line), 1, 2) || '.png' AS src, (length(line) % 60)::DOUBLE AS width, ((page + ln) % 50)::DOUBLE AS height FROM v_lines""",
    "v_sections": """SELECT 's' || doc_id AS id, doc_id AS pos, doc_id || '. ' || regexp_extract(text, '([^\\s]+)', 1) AS title, text, CASE doc_id % 5 WHEN 0 THEN 'deleted' WHEN 1 THEN 'edit' END AS op, 'New ' || regexp_extract(text, '([^\\s]+)', 1) AS new_title, source FROM documents""",
}
NEEDS = {"v_images": ["v_lines"]}


def with_views(sql: str, *names: str) -> str:
    """SQL that starts with the views it reads; further expressions may follow under its own WITH."""
    listed = reduce(lambda acc, n: acc + [x for x in [*NEEDS.get(n, []), n] if x not in acc], names, [])
    head = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in listed)
    body = sql.strip()
    if not names:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"{head},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"
