"""Queries that run the translation driver over real chapters, with reruns and persisted state, and their SQL counterparts.

Chapters are made of the documents: a table, a code block, a heading and the lines as paragraphs. The translator writes a T before
what it is asked for; a text of 40 characters and more is sent back as it is until the seed reaches its length modulo 7, so that
some chunks pass at once, some within a run, others only in a later one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import translation as T
from ..session import table
from ..sources.corpus import configurations
from .views import with_views

CHUNK_CHARS = 300
RUNS = 3


def v_source(spark, d):
    """Chapters (path, lang, text) by document."""
    word = F.regexp_replace(F.regexp_extract("text", "([^\\s]+)", 1), "[^A-Za-z]", "")
    text = F.concat(F.lit("| name | value |\n|---|---|\n| "), word, F.lit(" | 12 |\n\n```py\ncode\n```\n\n### Part\n\n"), F.regexp_replace("text", "\n", "\n\n"))
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("ko").alias("lang"), text.alias("text"))


def reluctant(text: str, seed: int) -> str:
    return text if len(text) >= 40 and seed < len(text) % 7 else "T" + text


def t2(spark, d):
    """The second run: chunks that the first one settled are taken over, the others are asked for again."""
    states = T.settled(v_source(spark, d), reluctant, CHUNK_CHARS, 2)
    return states[-1].select("path", "chunk_ix", "reused", "attempts", F.md5("result").alias("digest"))


def t3(spark, d):
    """The first run: attempts, calls of the function, result and failure of each chunk."""
    state = T.translated(v_source(spark, d), reluctant, CHUNK_CHARS)
    return state.select("path", "chunk_ix", F.md5("result").alias("digest"), "attempts", "calls", "failed")


def t4(spark, d):
    """Failed chunks that are left after each of the runs."""
    states = T.settled(v_source(spark, d), reluctant, CHUNK_CHARS, RUNS)
    left = [s.groupBy("path").agg(F.count_if("failed").alias(f"left_{i}")) for i, s in enumerate(states)]
    out = left[0]
    for more in left[1:]:
        out = out.join(more, "path")
    for i in range(len(states), RUNS):
        out = out.withColumn(f"left_{i}", F.lit(0).cast("long"))
    return out


def sk4(spark, d):
    """The mirror after the first run: chapters with their blocks put back, markers beside incomplete ones, configurations."""
    chapters = v_source(spark, d)
    state = T.translated(chapters, reluctant, CHUNK_CHARS)
    files = T.mirror(chapters, state, "out")
    fields = F.from_json("content", "incomplete_chunks array<long>, total_chunks long, chunk_chars long, chunks array<string>")
    told = F.concat_ws("|", F.array_join(F.transform(fields["incomplete_chunks"], lambda x: x.cast("string")), ","), fields["total_chunks"].cast("string"), fields["chunk_chars"].cast("string"), F.array_join(fields["chunks"], "~"))
    files = files.select("path", "kind", F.md5(F.when(F.col("kind") == "marker", told).otherwise(F.col("content"))).alias("digest"))
    books = table(spark, d, "documents").select("source").distinct()
    given = F.when(F.length("source") % 2 == 0, F.concat(F.lit("# note\ntitle: "), "source", F.lit("\nlanguage: en\nauthor: é\n")))
    config = configurations(books.select(F.concat(F.lit("out/"), "source", F.lit("/book.yaml")).alias("path"), given.alias("config")), "ko")
    return files.unionByName(config.select("path", F.lit("config").alias("kind"), F.md5("config").alias("digest")))


# prose of a chunk is what isn't its table; k is the seed from which on it is translated
CHUNKS = f"""s AS (SELECT source || '/' || doc_id || '.md' AS path, regexp_replace(regexp_extract(text, '([^\\s]+)', 1), '[^A-Za-z]', '', 'g') AS word, text FROM documents),
 p AS (SELECT path, word, para, row_number() OVER (PARTITION BY path ORDER BY ix) AS i FROM (
  SELECT path, word, '| name | value |' || chr(10) || '|---|---|' || chr(10) || '| ' || word || ' | 12 |' AS para, -2 AS ix FROM s
  UNION ALL SELECT path, word, '@@TBLOCK_0@@' || chr(10) || '### Part', -1 FROM s
  UNION ALL SELECT path, word, unnest(string_split(text, chr(10))), generate_subscripts(string_split(text, chr(10)), 1) FROM s) WHERE trim(para) <> ''),
 walk AS (SELECT path, word, i, para, length(para) AS len, 0 AS ix FROM p WHERE i = 1 UNION ALL
  SELECT p.path, p.word, p.i, p.para, CASE WHEN w.len + 2 + length(p.para) <= {CHUNK_CHARS} THEN w.len + 2 + length(p.para) ELSE length(p.para) END, CASE WHEN w.len + 2 + length(p.para) <= {CHUNK_CHARS} THEN w.ix ELSE w.ix + 1 END
  FROM walk w JOIN p ON p.path = w.path AND p.i = w.i + 1),
 c AS (SELECT path, ix AS chunk_ix, any_value(word) AS word, min(i) = 1 AS tabled, string_agg(para, chr(10) || chr(10) ORDER BY i) FILTER (WHERE i > 1) AS prose FROM walk GROUP BY path, ix),
 k AS (SELECT *, CASE WHEN length(prose) >= 40 THEN length(prose) % 7 ELSE 0 END AS k, length(regexp_replace(prose, '[^A-Za-z]', '', 'g')) >= 20 AS latin FROM c),
 cells AS (SELECT *, '| Tname | Tvalue |' || chr(10) || '|---|---|' || chr(10) || '| ' || CASE WHEN word = '' THEN '' WHEN length(word) >= 40 AND length(word) % 7 > 0 THEN word ELSE 'T' || word END || ' | 12 |' AS made FROM k),
 one AS (SELECT path, chunk_ix, word, tabled, prose, k, CASE WHEN tabled THEN made || coalesce(chr(10) || chr(10) || CASE WHEN k > 0 THEN prose ELSE 'T' || prose END, '')
   WHEN k > 0 AND (NOT latin OR k > 2) THEN prose ELSE 'T' || prose END AS result, CASE WHEN tabled OR (k > 0 AND NOT latin) THEN 1 ELSE least(k + 1, 3) END AS attempts, NOT tabled AND latin AND k > 2 AS failed FROM cells)"""
FAILED_LATER = "NOT tabled AND failed AND k > {}"

ALL = {
    "t2_chunk_cache": (t2, with_views(f"WITH RECURSIVE {CHUNKS} SELECT path, chunk_ix::BIGINT AS chunk_ix, NOT failed AS reused, (CASE WHEN failed THEN least(k + 1, 6) ELSE attempts END)::INT AS attempts, md5(CASE WHEN failed AND k <= 5 THEN 'T' || prose ELSE result END) AS digest FROM one")),
    "t3_bounded_retry": (t3, with_views(f"WITH RECURSIVE {CHUNKS} SELECT path, chunk_ix::BIGINT AS chunk_ix, md5(result) AS digest, attempts::INT AS attempts, (attempts * (CASE WHEN tabled THEN 2 + (word <> '')::INT + (prose IS NOT NULL)::INT ELSE 1 END))::INT AS calls, failed FROM one")),
    "t4_convergence": (t4, with_views(f"WITH RECURSIVE {CHUNKS} SELECT path, count(*) FILTER (WHERE failed) AS left_0, count(*) FILTER (WHERE failed AND k > 5) AS left_1, count(*) FILTER (WHERE failed AND k > 8) AS left_2 FROM one GROUP BY path")),
    "sk4_translated_mirror": (sk4, with_views(f"""WITH RECURSIVE {CHUNKS},
 g AS (SELECT path, string_agg(result, chr(10) || chr(10) ORDER BY chunk_ix) AS whole, string_agg(result, '~' ORDER BY chunk_ix) AS listed, string_agg((chunk_ix + 1)::VARCHAR, ',' ORDER BY chunk_ix) FILTER (WHERE failed) AS bad, count(*) AS n FROM one GROUP BY path)
 SELECT 'out/' || path AS path, 'chapter' AS kind, md5(replace(whole, '@@TBLOCK_0@@', '```py' || chr(10) || 'code' || chr(10) || '```' || chr(10))) AS digest FROM g
 UNION ALL SELECT 'out/' || path || '.incomplete.json', 'marker', md5(bad || '|' || n || '|{CHUNK_CHARS}|' || listed) FROM g WHERE bad IS NOT NULL
 UNION ALL SELECT 'out/' || source || '/book.yaml', 'config', md5(CASE WHEN length(source) % 2 = 0 THEN 'title: ' || source || chr(10) || 'language: ko' || chr(10) || 'author: é' || chr(10) ELSE 'language: ko' || chr(10) END) FROM (SELECT DISTINCT source FROM documents)""")),
}
