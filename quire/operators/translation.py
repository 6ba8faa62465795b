"""Chunk-wise text transformation: validation, bounded retry, resume state and packing into chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.markdown import map_chunk, protected_blocks, restored
from ..functions.text import HANGUL, strip
from ..session import written

RETRIES = 2


def hangul_ratio(c: Column) -> Column:
    """Share of Hangul syllables, 0 for an empty text."""
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(c, "[^가-힣]", "")) / F.length(c))


def is_echo(original: Column, result: Column, least: int = 20) -> Column:
    """The result is the original but for white space at the ends, and the original has enough Latin letters to matter."""
    return (strip(original) == strip(result)) & (F.length(F.regexp_replace(original, "[^A-Za-z]", "")) >= least)


def chunk_failed(original: Column, result: Column, lang: Column, threshold: float = 0.05) -> Column:
    return F.when(lang == "en", hangul_ratio(result) > threshold).when(lang == "ko", is_echo(original, result)).otherwise(F.lit(False))


def cell_needs(cell: Column, lang: Column) -> Column:
    return F.when(lang == "ko", cell.rlike("[A-Za-z]")).otherwise(cell.rlike(HANGUL))


def cell_hallucinated(original: Column, result: Column) -> Column:
    return F.contains(result, F.lit("\n")) | (F.length(result) > 4 * F.length(original) + 40)


def pack_paragraphs(paragraphs: Column, limit: int, separator: str = "\n\n") -> Column:
    """Paragraphs filled greedily into chunks of at most `limit` characters; a longer one stays whole."""
    sep = len(separator)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        fits = acc.cur.isNotNull() & (F.length(acc.cur) + sep + F.length(p) <= limit)
        done = F.when(acc.cur.isNull() | fits, acc.done).otherwise(F.concat(acc.done, F.array(acc.cur)))
        return F.struct(done.alias("done"), F.when(fits, F.concat(acc.cur, F.lit(separator), p)).otherwise(p).alias("cur"))

    return F.aggregate(paragraphs, start, step, lambda a: F.when(a.cur.isNull(), a.done).otherwise(F.concat(a.done, F.array(a.cur))))


def chunk_text(text: Column, limit: int) -> Column:
    """Chunks of a text at blank lines; a text of white space alone is one chunk, an empty one has none."""
    paragraphs = F.filter(F.split(text, "\n\n"), lambda p: strip(p) != "")
    return F.when(F.size(paragraphs) > 0, pack_paragraphs(paragraphs, limit)).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def resume_action(resume: Column, exists: Column, marked: Column, chunks_known: Column, same_limit: Column) -> Column:
    """full, skip or retry, by the decision table of a resumed run."""
    return F.when(~resume | ~exists, "full").when(~marked, "skip").when(chunks_known & same_limit, "retry").otherwise("full")


def marker_upsert(state: DataFrame, outcome: DataFrame) -> DataFrame:
    """State after a run: a path with failed chunks gets its new marker, a path that is clean loses it, others keep theirs."""
    failed = outcome.filter(F.size("incomplete_chunks") > 0)
    return state.join(outcome.select("path"), "path", "left_anti").unionByName(failed, allowMissingColumns=True)


# What a translator is asked, before and after the name of the language.
PROMPT = (
    "Translate the following text to ",
    ". Keep the Markdown formatting exactly as in the input — do not add, remove, or invent any Markdown elements (headings, lists, links, tables, etc.) that are not already there. "
    "Do not add examples, explanations, or commentary of your own — translate only what is given. Output only the translated text, with no preamble.",
)


def prompt(chunk: Column, lang: Column) -> Column:
    """The request for one chunk; languages go by their English name where it is known."""
    name = F.when(lang == "en", "English").when(lang == "ko", "Korean").otherwise(lang)
    return F.concat(F.lit(PROMPT[0]), name, F.lit(PROMPT[1] + "\n\n"), chunk)


#: Chunks of a run: what was asked, what came back, how often in all (attempts) and in this run (calls of the function).
STATE = "path string, chunk_ix long, n_chunks long, chunk_chars long, lang string, digest string, original string, result string, attempts int, failed boolean, error string, calls int, reused boolean"
_FRESH = "result string, attempts int, failed boolean, error string, calls int"
#: What an error message is cut to.
ERROR_CHARS = 400


def chunked(chapters: DataFrame, chunk_chars: int) -> DataFrame:
    """(path, chunk_ix from 0, n_chunks, chunk_chars, lang, digest, original) of chapters (path, lang, text), blocks masked.

    A chapter that is null or empty has no chunks.
    """
    masked = chapters.select("path", "lang", protected_blocks(F.coalesce("text", F.lit("")))["text"].alias("text"))
    chunks = masked.select("path", "lang", chunk_text(F.col("text"), chunk_chars).alias("c"))
    rows = chunks.select("path", "lang", F.size("c").cast("long").alias("n_chunks"), F.posexplode("c").alias("chunk_ix", "original"))
    return rows.select("path", F.col("chunk_ix").cast("long").alias("chunk_ix"), "n_chunks", F.lit(chunk_chars).cast("long").alias("chunk_chars"), "lang", F.sha2("original", 256).alias("digest"), "original")


def map_with_retry(chunks: DataFrame, transform: Callable[[str, int], str], check: Callable[[str, str, str | None], bool] | None = None, retries: int = RETRIES) -> DataFrame:
    """(path, chunk_ix, result, attempts, failed, error, calls): an injected function over chunks (path, chunk_ix, original, lang; tried if there were earlier runs).

    transform(text, seed) gets the prose of a chunk, and its tables cell by cell; seed is the number of attempts so far, those of
    earlier runs (tried) included, so that a sampler draws anew. While the check of the whole chunk fails it is tried again, and the
    last result stays. What the function raises is kept as the chunk's error, which fails the chunk and no other; its result is the
    original if there is none. The function may not be deterministic: write the result before it is used twice. Null chunks and
    chunks of white space alone pass through untouched.
    """
    tried = F.col("tried") if "tried" in chunks.columns else F.lit(0).alias("tried")
    made = _mapped(chunks.select("path", "chunk_ix", "original", "lang", tried), transform, check or failed_in_python, retries)
    return made.select("path", "chunk_ix", *[c.split()[0] for c in _FRESH.split(", ")])


def _mapped(chunks: DataFrame, transform: Callable[[str, int], str], check: Callable[[str, str, str | None], bool], retries: int) -> DataFrame:
    """chunks (original, lang, tried, any more) with _FRESH, so that what was made needs no join with what was asked.

    With a column `known`, rows that have it true aren't asked for: their `former` result stays, with the attempts so far.
    """

    def one(original: str, lang: str | None, tried: int) -> tuple:
        calls = 0

        def ask(text: str) -> str:
            nonlocal calls
            calls += 1
            return transform(text, seed)

        result, error, failed = original, None, True
        for seed in range(tried, tried + retries + 1):
            try:
                result, error = map_chunk(original, ask, lambda cell: cell_needs_in_python(cell, lang), cell_hallucinated_in_python), None
                failed = check(original, result, lang)
            except Exception as e:  # the function is the caller's: whatever it raises belongs to this chunk
                error, failed = f"{type(e).__name__}: {e}"[:ERROR_CHARS], True
            if not failed:
                break
        return result, seed + 1, failed, error, calls

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            settled_ = zip(f["known"], f["former"]) if "known" in f else [(False, None)] * len(f)
            for original, lang, tried, (known, former) in zip(f["original"], f["lang"], f["tried"], settled_):
                blank = original is None or not original.strip()
                out.append((former, int(tried), False, None, 0) if known else (original, 0, False, None, 0) if blank else one(original, lang, int(tried)))
            made = pd.DataFrame(out, columns=["result", "attempts", "failed", "error", "calls"], index=f.index)
            yield pd.concat([f[kept], made], axis=1)

    kept = [c for c in chunks.columns if c not in ("tried", "former")]
    given = ", ".join(f"`{c}` {kind}" for c, kind in chunks.dtypes if c in kept)
    return chunks.mapInPandas(run, f"{given}, {_FRESH}")


def translated(chapters: DataFrame, transform: Callable[[str, int], str], chunk_chars: int, before: DataFrame | None = None, retries: int = RETRIES, progress: Observation | None = None) -> DataFrame:
    """The state (STATE) after a run over chapters (path, lang, text).

    before is the state of an earlier run that is resumed: chunks of the same place, digest and limit that didn't fail are taken
    over, the others go to the function with their attempts so far. A chunk whose text has changed starts anew. progress gets the
    numbers of chunks that were asked for and that failed.
    """
    now = chunked(chapters, chunk_chars)
    names = [c.split()[0] for c in STATE.split(", ")]
    if before is None:
        asked = now.withColumns({"tried": F.lit(0), "former": F.lit(None).cast("string"), "known": F.lit(False)})
    else:
        # results of failed chunks aren't moved: they are asked for anew
        known = before.select("path", "chunk_ix", "digest", "chunk_chars", F.when(~F.col("failed"), F.col("result")).alias("former"), F.col("attempts").alias("tried"), (~F.col("failed")).alias("known"))
        asked = now.join(known, ["path", "chunk_ix", "digest", "chunk_chars"], "left").withColumns({"tried": F.coalesce("tried", F.lit(0)), "known": F.coalesce("known", F.lit(False))})
    made = _mapped(asked, transform, failed_in_python, retries).withColumnRenamed("known", "reused")
    if progress is not None:
        fresh = ~F.col("reused")
        made = made.observe(progress, F.count_if(fresh).alias("asked"), F.count_if(fresh & F.col("failed")).alias("failed"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))
    return written(made.select(*names))


def settled(chapters: DataFrame, transform: Callable[[str, int], str], chunk_chars: int, runs: int, retries: int = RETRIES) -> list[DataFrame]:
    """States of resumed runs, until no chunk has failed or the number of runs is reached.

    Between these runs no chapter changes, so a further one asks for the failed chunks of the last state and writes no others.
    """
    states: list[DataFrame] = []
    while len(states) < runs and (not states or not states[-1].filter("failed").isEmpty()):
        states.append(_again(states[-1], transform, retries) if states else translated(chapters, transform, chunk_chars, None, retries))
    return states


def _again(state: DataFrame, transform: Callable[[str, int], str], retries: int) -> DataFrame:
    """The state after a run over the same chapters: what didn't fail is taken over where it lies, the rest is asked for anew."""
    names = state.columns
    asked = state.filter("failed").drop("result", "failed", "error", "calls", "reused").withColumnRenamed("attempts", "tried")
    fresh = written(_mapped(asked, transform, failed_in_python, retries).withColumn("reused", F.lit(False)).select(*names))
    kept = state.filter(~F.col("failed")).withColumns({"calls": F.lit(0), "reused": F.lit(True)})
    return kept.select(*names).unionByName(fresh)


def reassembled(chapters: DataFrame, state: DataFrame) -> DataFrame:
    """(path, text): the chunks of each chapter in order, with its blocks put back."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_ix", "result")))
    joined = state.groupBy("path").agg(F.array_join(F.transform(ordered, lambda r: r.result), "\n\n").alias("made"))
    rows = chapters.select("path", protected_blocks(F.coalesce("text", F.lit("")))["blocks"].alias("blocks")).join(joined, "path", "left")
    return rows.select("path", restored(F.coalesce("made", F.lit("")), F.col("blocks")).alias("text"))


def markers(state: DataFrame) -> DataFrame:
    """(path, incomplete_chunks from 1, total_chunks, chunk_chars, chunks) of the chapters with failed chunks."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_ix", "result")))
    failed = F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("chunk_ix") + 1)))
    g = state.groupBy("path").agg(failed.alias("incomplete_chunks"), F.max("n_chunks").alias("total_chunks"), F.max("chunk_chars").alias("chunk_chars"), F.transform(ordered, lambda r: r.result).alias("chunks"))
    return g.filter(F.size("incomplete_chunks") > 0)


def mirror(chapters: DataFrame, state: DataFrame, out: str) -> DataFrame:
    """(path, kind, content): the translated chapters below `out`, and beside each incomplete one its marker as JSON."""
    below = lambda suffix: F.concat(F.lit(f"{out.rstrip('/')}/"), "path", F.lit(suffix))
    files = reassembled(chapters, state).select(below("").alias("path"), F.lit("chapter").alias("kind"), F.col("text").alias("content"))
    notes = markers(state).select(below(".incomplete.json").alias("path"), F.lit("marker").alias("kind"), F.to_json(F.struct("incomplete_chunks", "total_chunks", "chunk_chars", "chunks")).alias("content"))
    return files.unionByName(notes)


_LATIN, _HANGUL = re.compile("[A-Za-z]"), re.compile("[가-힣]")


def cell_needs_in_python(cell: str, lang: str | None) -> bool:
    return bool((_LATIN if lang == "ko" else _HANGUL).search(cell))


def cell_hallucinated_in_python(original: str, result: str) -> bool:
    return "\n" in result or len(result) > 4 * len(original) + 40


def failed_in_python(original: str, result: str, lang: str | None) -> bool:
    """The check of a chunk as a plain function, for use beside the injected one."""
    if lang == "en":
        return bool(result) and sum("가" <= c <= "힣" for c in result) / len(result) > 0.05
    if lang == "ko":
        return original.strip() == result.strip() and sum(c.isascii() and c.isalpha() for c in original) >= 20
    return False
