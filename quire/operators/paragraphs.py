"""Repair of hard-wrapped text, as flags per line, running sums and one ordered aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .corpus import bullet_chars

# Marks of heading and code lines in extracted text, and forms of list and step markers.
HEADING, CODE, CODE_END = "\x01HEADING\x01", "\x01CODE\x01", "\x01/CODE\x01"
BULLET = "^(?:[•●\\-*◦‣]|\\d+[.)]|[a-zA-Z][.)])\\s"
STEP = "^#\\d+(?:\\.\\d+)*\\)\\s"


def repair(lines: DataFrame, least_bullets: int = 5) -> DataFrame:
    """(doc, page, text): wrapped lines joined to paragraphs.

    Bullets and steps in mid-line are split off first. A paragraph ends at a blank line, at .!?: at a line's end, before a bullet,
    a heading, a table or image row, or code. A line that ends in a letter and a hyphen joins a following lower-case line without
    it. Table and image rows that follow each other stay together, code between its marks stays as it is in a fence, and a line
    that starts with # is escaped. Letters that start many lines of a document count as its bullets.
    """
    cut = F.regexp_replace("line", "(?<=\\S) (?=[•●◦‣]\\s)", "\n")
    cut = F.regexp_replace(cut, "(?<=\\S) (?=#\\d+(?:\\.\\d+)*\\)\\s)", "\n")
    s = lines.select("doc", "page", "ln", F.posexplode(F.split(cut, "\n")).alias("part", "raw")).withColumn("at", F.struct("ln", "part"))
    own = bullet_chars(s.select(F.struct("doc", "page").alias("doc"), F.col("raw").alias("line")), least_bullets)
    own = own.select("doc.doc", "doc.page", "ch").groupBy("doc", "page").agg(F.collect_set("ch").alias("own"))
    w = Window.partitionBy("doc", "page").orderBy("ln", "part")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    line = strip(F.col("raw"))
    s = s.withColumn("line", line).join(own, ["doc", "page"], "left")
    # a mark toggles: an opening one counts outside code only, a closing one inside only
    mark = F.when(F.col("line") == CODE, 1).when(F.col("line") == CODE_END, -1)
    s = s.withColumn("_last", F.last(mark, ignorenulls=True).over(upto)).withColumn("_mark", mark)
    in_code = F.coalesce(F.col("_last") == 1, F.lit(False)) & F.col("_mark").isNull()
    kind = (
        F.when(F.col("_mark").isNotNull(), "mark").when(in_code, "code").when(F.col("line") == "", "blank").when(F.col("line").rlike(f"^{HEADING}\\s+\\S"), "heading")
        .when(F.col("line").rlike("^\\|.*\\|$") | F.col("line").rlike("^!\\[[^\\]]*\\]\\([^)]*\\)$"), "block").otherwise("prose")
    )
    s = s.withColumn("kind", kind)
    step = F.col("line").rlike(STEP)
    text = (
        F.when(F.col("kind") == "code", F.col("raw")).when(F.col("kind") == "heading", F.concat(F.lit("## "), strip(F.substr("line", F.lit(len(HEADING) + 1)))))
        .when((F.col("kind") == "prose") & F.col("line").startswith("#"), F.concat(F.lit("\\"), F.col("line"))).otherwise(F.col("line"))
    )
    s = s.withColumn("text", text)
    bullet = F.col("text").rlike(BULLET) | step | ((F.substring("text", 2, 1) == " ") & F.coalesce(F.array_contains("own", F.lower(F.substring("text", 1, 1))), F.lit(False)))
    before, ended = F.lag("kind").over(w), F.lag(F.col("text").rlike("[.!?:]$")).over(w)
    # prose starts anew after anything else, after a finished sentence and at a bullet; blocks and code run on among themselves
    new = F.when(F.col("kind") == "prose", before.isNull() | (before != "prose") | ended | bullet).when(F.col("kind").isin("block", "code"), before.isNull() | (before != F.col("kind"))).otherwise(F.lit(True))
    lower = F.lower(F.substring("text", 1, 1))
    hyphen = (F.col("kind") == "prose") & ~new & F.lag(F.col("text").rlike("(?U)\\w-$")).over(w) & (F.substring("text", 1, 1) == lower) & (lower != F.upper(lower))
    s = s.withColumn("new", new).withColumn("hyphen", F.coalesce(hyphen, F.lit(False)))
    s = s.withColumn("next_hyphen", F.lead("hyphen", 1, False).over(w)).withColumn("para", F.sum(F.col("new").cast("int")).over(upto))
    piece = F.when(F.col("next_hyphen"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    glue = F.when(F.col("new") | F.col("hyphen"), F.lit("")).when(F.col("kind") == "prose", F.lit(" ")).otherwise(F.lit("\n"))
    s = s.filter(~F.col("kind").isin("blank", "mark"))
    joined = lambda value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "part", value.alias("v")))), lambda r: r.v), "")
    paras = s.groupBy("doc", "page", "para", "kind").agg(joined(F.concat(glue, piece)).alias("p"))
    fenced = F.when(F.col("kind") == "code", F.concat(F.lit("```\n"), F.col("p"), F.lit("\n```"))).otherwise(F.col("p"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", fenced.alias("p")))), lambda r: r.p), "\n\n")
    made = paras.groupBy("doc", "page").agg(ordered.alias("text"))
    return lines.select("doc", "page").distinct().join(made, ["doc", "page"], "left").select("doc", "page", F.coalesce("text", F.lit("")).alias("text"))
