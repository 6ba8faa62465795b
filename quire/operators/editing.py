"""A staged edit session as a change log: last write per key wins, applied by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "id", by: str = "seq") -> DataFrame:
    """The last entry of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def status(op: Column) -> Column:
    """Deleted beats modified, modified beats original."""
    return F.when(op == "deleted", "deleted").when(op.isNotNull(), "modified").otherwise("original")


def numbered_title(old: Column, new: Column) -> Column:
    """A new title behind the number that the old one had; a number typed by hand goes."""
    prefix = F.regexp_extract(old, "^(\\d+\\.\\s+)", 1)
    return F.concat(prefix, F.regexp_replace(new, "^\\d+\\.\\s+", ""))


def apply_edits(sections: DataFrame, log: DataFrame) -> DataFrame:
    """Sections after the log: deleted ones go, edited ones get text and title; entries for unknown sections do nothing."""
    staged = latest(log).select("id", "op", F.col("title").alias("_title"), F.col("markdown").alias("_markdown"))
    both = sections.join(staged, "id", "left").filter("op is null or op <> 'deleted'")
    edited = F.col("op") == "edit"
    return both.withColumn("title", F.when(edited, numbered_title(F.col("title"), F.col("_title"))).otherwise(F.col("title"))).withColumn("text", F.when(edited, F.col("_markdown")).otherwise(F.col("text"))).drop("_title", "_markdown")


def unlink_dead(links: DataFrame, deleted: DataFrame) -> DataFrame:
    """Links (section, ix, target, text): html is plain text where the target section was deleted."""
    gone = deleted.select(F.concat(F.lit("#"), F.col("id")).alias("target"), F.lit(True).alias("_gone"))
    kept = F.concat(F.lit('<a href="'), F.col("target"), F.lit('">'), F.col("text"), F.lit("</a>"))
    return links.join(gone, "target", "left").withColumn("html", F.when(F.col("_gone"), F.col("text")).otherwise(kept)).drop("_gone")


def reinserted(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Children of a section after its content is replaced: preserved elements come back where they stood.

    nodes (id, ix, kind, html) are the old children, kind `content` or another; fresh (id, ix, html) the new content. An element
    that followed k content tags stands before new tag k, or at the end where there are fewer; equal places keep their order.
    """
    w = Window.partitionBy("id").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.when(F.col("kind") == "content", 1).otherwise(0)).over(w), F.lit(0))
    old = nodes.withColumn("k", seen).filter("kind <> 'content'").select("id", "k", F.lit(0).alias("rank"), "ix", "html")
    n = fresh.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    old = old.join(n, "id", "left").withColumn("k", F.least("k", F.coalesce("n", F.lit(0)))).drop("n")
    place = F.row_number().over(Window.partitionBy("id").orderBy("ix")) - 1
    new = fresh.select("id", place.alias("k"), F.lit(1).alias("rank"), "ix", "html")
    order = Window.partitionBy("id").orderBy("k", "rank", "ix")
    return old.unionByName(new).withColumn("pos", F.row_number().over(order)).select("id", "pos", "html")


def summary(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Six counts of what an edit session did."""
    n = lambda kind: F.count_if(F.col("change") == kind)
    kinds = ("image_delete", "image_replace", "image_add", "diagram_delete", "section_edit", "section_delete")
    return changes.groupBy(*keys).agg(*[n(k).alias(f"n_{k}") for k in kinds])
