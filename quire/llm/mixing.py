"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets are a water level over the sources. Blocks go to sources, and a source's blocks to its shards, by the highest quotients
target / (2 quota + 1). In a shard the documents stand in seeded order, and their words, end to end, are cut into blocks of equal
length (to a word); a quota is so many whole rounds, and for the rest of it the first blocks. As the order is drawn by seed, so are
these blocks, and they hold whole documents but for one at their end, whatever the length of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, split_by_keys, words_of, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_ROUNDS = 2.0
#: Rows of a shard, on average: a source with a third of all rows is dealt to as many shards as it needs.
SHARD_ROWS = 2000
MOST_BLOCK_WORDS = 256
SEED = 7
#: Passes over the parties, and sections that each cuts the bracket of the scale into.
PASSES = 4
SECTIONS = 64

def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_ROUNDS) -> DataFrame:
    """Adds target to (source, source_size): share * all words by weight, none above most * its size.

    Sources are weighted in the order of their code points, null last. Handing on the excess until none is above ends at one
    level times each weight, cut at the ceilings: sources are taken by ceiling / weight, and the level is the first that the
    uncut ones can hold.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    i = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (i + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(all_rows))
    s = s.withColumn("cut", F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("cut")) / F.col("rest"))
    # of the sources that their level leaves uncut, the first has the highest
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.col("level"))).over(all_rows)
    return s.withColumn("level", level).select("source", "source_size", F.least("ceiling", F.coalesce(F.col("level") * F.col("weight"), F.col("ceiling"))).alias("target"))


def apportion(parties: DataFrame, votes: str, most: str, total: str, by: list[str], order: list[str], name: str) -> DataFrame:
    """Sainte-Laguë: adds `name`, integer seats that add up to `total` in each group of `by` where the ceilings allow, none above `most`.

    The next seat goes to the highest quotient votes / (2 seats + 1) of a party below its ceiling, ties to the first in `order`. At a
    scale x a party has min(most, floor((votes x + 1) / 2)) seats, the number of its quotients down to 1 / x. Passes over all parties
    narrow the scale between one that gives too few seats and one that gives enough; what few quotients lie between are ranked. A party
    without votes gets none. Every pass is an aggregate; only the quotients of the last bracket are ranked in one group.
    """
    key = by or ["_all"]
    folder = shared_dir(parties.sparkSession)
    rows = parties if by else parties.withColumn("_all", F.lit(0))
    v, cap = F.col(votes).cast("double"), F.when(F.col(votes) > 0, F.col(most)).otherwise(0).cast("long")
    rows = written(rows.withColumns({"_v": v, "_cap": cap}), folder, "parties")

    def seats(x: Column) -> Column:
        return F.when(F.col("_v") > 0, F.least(F.col("_cap"), F.floor((F.col("_v") * x + 1) / 2))).otherwise(0).cast("long")

    # below low no party has a seat; at high all have as many as they may
    scale = rows.filter("_cap > 0").groupBy(*key).agg((0.5 / F.max("_v")).alias("_low"), F.max(2 * (F.col("_cap") + 1) / F.col("_v")).alias("_high"))
    for i in range(PASSES):
        step = F.col("_low") * F.pow(F.col("_high") / F.col("_low"), F.col("_i") / SECTIONS)
        tried = scale.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(SECTIONS)))).withColumn("_x", F.when(F.col("_i") == 0, F.col("_low")).when(F.col("_i") == SECTIONS, F.col("_high")).otherwise(step))
        counted = rows.join(tried, key).groupBy(*key, "_i", "_x").agg((F.sum(seats(F.col("_x"))) >= F.max(total)).alias("_ok"))
        low = F.max(F.when(~F.col("_ok") | (F.col("_i") == 0), F.col("_x"))).alias("_low")
        high = F.min(F.when(F.col("_ok") | (F.col("_i") == SECTIONS), F.col("_x"))).alias("_high")
        scale = written(counted.groupBy(*key).agg(low, high), folder, f"scale{i}")
    named = rows.join(scale, key, "left").withColumns({"_sure": F.coalesce(seats(F.col("_low")), F.lit(0)), "_may": F.coalesce(seats(F.col("_high")), F.lit(0))})
    left = named.groupBy(*key).agg((F.max(total) - F.sum("_sure")).alias("_left"))
    open_ = named.filter("_may > _sure").select(*key, *order, "_v", F.explode(F.sequence("_sure", F.col("_may") - 1)).alias("_s")).join(left, key)
    w = Window.partitionBy(*key).orderBy((F.col("_v") / (2 * F.col("_s") + 1)).desc(), *order)
    more = open_.withColumn("_k", F.row_number().over(w)).filter("_k <= _left").groupBy(*key, *order).agg(F.count(F.lit(1)).alias("_more"))
    out = named.join(more, [*key, *order], "left").withColumn(name, F.col("_sure") + F.coalesce("_more", F.lit(0)))
    return out.select(*parties.columns, name)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_ROUNDS, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row, with what of it is taken.

    Further columns: source, text_hash, whole (how often all of it is taken) and part (how many of its first words once more). A null
    text has size 0 and takes nothing; a null source is one source, weighted last; repeated rows and null ids are rows like any other;
    an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    read = docs.select(F.col("doc_id").cast("long"), "source", F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("size"))
    sized = written(read, folder, "sized")
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("rows") / shard_rows)).cast("int")
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), folder, "sources")
    aimed = targets(sources.select("source", "source_size"), weights, share, most)
    aimed = aimed.join(sources.select(F.col("source").alias("s"), n_shards.alias("shards")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # one size of block for all: small enough that the smallest target is met to a part in a thousand
    least = F.min(F.when(F.col("target") >= 1, F.col("target"))).over(Window.partitionBy())
    block = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCK_WORDS), F.floor(F.coalesce(least, F.lit(0)) / 1000))).cast("long")
    all_target = F.sum("target").over(Window.partitionBy())
    aimed = written(aimed.withColumns({"block": block, "blocks": F.floor(all_target / block + 0.5).cast("long"), "id": F.xxhash64(F.lit(seed), F.col("source").isNull(), "source")}), folder, "aimed")
    known = aimed.select(F.col("source").alias("s"), "id", "shards", "source_size", "target", "block", "blocks")
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash"), F.col("shards")).cast("int")
    dealt = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("shard", shard)
    dealt = written(dealt.select("doc_id", "source", "id", "text_hash", "size", "source_size", "target", "shard", "block", "blocks"), folder, "dealt")
    rings = dealt.groupBy("id", "source", "shard", "target", "block", "blocks").agg(F.sum("size").alias("ring"))
    n_blocks = F.when(F.col("ring") > 0, F.greatest(F.lit(1), F.floor(F.col("ring") / F.col("block") + 0.5))).otherwise(0).cast("long")
    rings = written(rings.withColumn("n_blocks", n_blocks).withColumn("most_blocks", F.floor(F.col("n_blocks") * most).cast("long")), folder, "rings")
    by_source = rings.groupBy("id", "source", "target", "blocks").agg(F.sum("most_blocks").alias("source_most"))
    quotas = apportion(by_source.withColumn("unnamed", F.col("source").isNull()), "target", "source_most", "blocks", [], ["unnamed", "source"], "quota")
    quotas = written(quotas.select("id", "quota"), folder, "quotas")
    seated = apportion(rings.join(quotas, "id"), "ring", "most_blocks", "quota", ["id"], ["shard"], "seats")
    n = F.greatest(F.col("n_blocks"), F.lit(1))
    drawn = {"whole": F.floor(F.col("seats") / n), "some": F.pmod(F.col("seats"), n)}
    seated = written(seated.select("id", "shard", "ring", "n_blocks", *[c.cast("long").alias(k) for k, c in drawn.items()]), folder, "seated")
    placed = dealt.join(seated, ["id", "shard"])
    key = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    w = Window.partitionBy("id", "shard").orderBy(key, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum("size").over(w), F.lit(0)))
    # block j begins at word j * ring div n_blocks: the first blocks end where block `some` begins
    end = F.expr("some * ring div greatest(n_blocks, 1)")
    placed = placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), end - F.col("at"))).cast("long"))
    taken = F.col("whole") * F.col("size") + F.col("part")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "text_hash", "whole", "part")


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, from the first one on, with the white space between them."""
    pattern = F.concat(F.lit(r"\A[\x20\x09-\x0D]*+((?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), n.cast("string"), F.lit("}+)"))
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a document comes once for each whole round, and once more if the blocks after the rounds hold it.

    So there are at most rounds + 1 rows of a document, and one document a shard is cut. Columns are those of docs, with text and
    n_chars of what is taken. Rows that are equal in id, text and source are told apart by a number in the order of all their
    columns, so that each takes its own part; only rows that a filter can't tell from such ones are moved for it.
    """
    folder = shared_dir(docs.sparkSession)
    plan = mix(docs, **options).filter("taken > 0")
    same_row = Window.partitionBy("doc_id", "text_hash", "source")
    plan = plan.withColumns({"twin": F.row_number().over(same_row.orderBy("taken", "part")), "twins": F.count(F.lit(1)).over(same_row)})
    plan = written(plan.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "text_hash", "source", "twin", "twins", "size", "whole", "part")]), folder, "plan")
    rows = docs.withColumn("_doc", F.col("doc_id").cast("long")).withColumn("_hash", F.xxhash64("text"))
    repeated = plan.filter("_twins > 1").select(F.xxhash64("_doc_id", "_text_hash").alias("k")).distinct()
    unsure, single = split_by_keys(rows, F.xxhash64("_doc", "_hash"), written(repeated, folder, "repeated"), folder, "repeated-bits")
    order = Window.partitionBy("_doc", "_hash", "source").orderBy(F.to_json(F.struct(*docs.columns)))
    rows = single.withColumn("_n", F.lit(1)).unionByName(unsure.withColumn("_n", F.row_number().over(order)))
    same = F.col("_doc").eqNullSafe(F.col("_doc_id")) & (F.col("_hash") == F.col("_text_hash")) & rows["source"].eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_twin"))
    joined = rows.join(plan, same)
    more = F.when(F.col("_part") == F.col("_size"), F.array("text")).when(F.col("_part") > 0, F.array(first_words(F.col("text"), F.col("_part")))).otherwise(F.array().cast("array<string>"))
    taken = F.concat(F.array_repeat("text", F.col("_whole").cast("int")), more)
    out = joined.select(*[c for c in docs.columns if c != "text"], F.explode(taken).alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
