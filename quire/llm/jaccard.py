"""Near copies: SimHash candidates, banded minima for what lies beyond their radius, and an exact check of every link.

Fingerprints of five-word shingles are linked through the Gray-order index of `simhash`. At a Jaccard similarity of 0.8 two
fingerprints differ in about ten of 64 bits, which no radius of that index reaches in bounded work, so that sets which share a
band of minima under random orders are candidates too. A pair of similarity 0.8 shares none of the bands with probability
(1 - 0.8 ** ROWS) ** BANDS = 0.000006. Every candidate is checked on the two whole sets before it is a link.

A bucket isn't paired up at once: its sets are compared with some pivots of its smallest parts, and linked parts merge. Sets of buckets
that are still apart meet once more by their rare shingles: of two similar sets n - ceil(t n) + 1 shingles each, in any one order, have
one in common. With the order of the meetings they cause, a passage that many share comes last and brings none together, so
no pair of a bucket is skipped and none grows to all its pairs. Where many sets share a rare shingle and aren't similar, most pairs are
ruled out where they meet: each set has the parities of its shingles' counts in SKETCH_BITS places, and two sets differ in at least as
many shingles as their parities do. That bound loses no pair; it tells little of sets with far more shingles than places. A pair counts
where its first common shingle stands, and only if what follows there in both sets is enough for a link; shingles that only linked sets
hold come first in the order, so a set that differs much from all others has few places left to meet them.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_rows, prepare, shared_dir, split_by_keys, utf8, written
from .graph import components
from .simhash import SEED, chosen

SHINGLE_WORDS = 5
#: Similarity of a link, as a fraction.
SIMILAR = (4, 5)
BANDS = 40
ROWS = 6
#: Sets of a bucket that all others of it are compared with at once.
PIVOTS = 4
#: Places of a sketch, a power of two.
SKETCH_BITS = 512
#: Rarer shingles that each rare shingle of a set carries along.
BEFORE = 64
_SKETCH = [f"b{i}" for i in range(SKETCH_BITS // 64)]

_TURNS = np.random.default_rng(SEED).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the shingles, sorted."""
    return np.unique(simhash.shingle_hashes(text, shingle_words))


def bands(found: np.ndarray) -> np.ndarray:
    """One key per band of minima; none for an empty set. Long texts are read in parts."""
    if not len(found):
        return np.zeros(0, np.uint64)
    low = np.full(len(_TURNS), 2**64 - 1, np.uint64)
    for a in range(0, len(found), 512):
        np.minimum(low, (found[a : a + 512, None] * _TURNS).min(0), out=low)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def _sets(docs: DataFrame, text: str, shingle_words: int) -> DataFrame:
    """(doc_id, text_hash, node, n, fp, bands): node is a hash of the shingle set, n its size."""

    def rows(b: dict) -> dict:
        node, size, fp, keys = [], [], [], []
        for t in utf8(b["text"]):
            every = simhash.shingle_hashes(t, shingle_words)
            found = np.unique(every)
            node.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            size.append(len(found))
            fp.append(simhash.majority(every))
            keys.append(bands(found).view(np.int64))
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        return {"doc_id": b["doc_id"], "text_hash": b["text_hash"], "node": signed(node), "n": size, "fp": signed(fp), "bands": keys}

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return read.mapInArrow(arrow_rows(rows, schema), "doc_id long, text_hash long, node long, n long, fp long, bands array<long>")


def _by_fingerprint(sets: DataFrame, folder: str, radius: int) -> DataFrame:
    """Candidate pairs (u, v) by SimHash: sets of one fingerprint, and sets whose fingerprints the Gray-order index links."""
    classes = written(sets.groupBy("fp").agg(F.min("node").alias("node")), folder, "classes")
    same = sets.select("fp", F.col("node").alias("u")).join(classes, "fp").select("u", F.col("node").alias("v"))
    near = simhash.links(classes.select("fp"), folder, radius)
    side = lambda fp, node: classes.select(F.col("fp").alias(fp), F.col("node").alias(node))
    linked = near.withColumnsRenamed({"u": "x", "v": "y"}).join(side("x", "u"), "x").join(side("y", "v"), "y").select("u", "v")
    return same.union(linked).filter("u <> v").distinct()


def _whole(nodes: DataFrame, sets: DataFrame, docs: DataFrame, text: str, shingle_words: int, folder: str) -> DataFrame:
    """(node, held): the shingles of each of the nodes. Only their texts are moved and hashed, but for a few that the filter lets through."""
    row = F.min(F.struct("doc_id", "text_hash")).alias("k")
    need = sets.join(nodes, "node", "left_semi").groupBy("node").agg(row).select("node", F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    need = written(need, folder, "need")
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col(text).alias("text"), F.xxhash64(text).alias("_text"))
    texts, _ = split_by_keys(texts, F.xxhash64("_doc", "_text"), need.select(F.xxhash64("_id", "_hash").alias("k")), folder, "need-bits")
    texts = texts.join(need, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))).select("node", "text")

    def held(b: dict) -> dict:
        return {"node": b["node"], "held": [shingles(t, shingle_words).astype("<u8").tobytes() for t in utf8(b["text"])]}

    hashed = texts.mapInArrow(arrow_rows(held, pa.schema([("node", pa.int64()), ("held", pa.binary())])), "node long, held binary")
    whole = written(hashed, folder, "whole")
    return whole if whole.count() == need.count() else whole.dropDuplicates(["node"])  # equal rows


def _checked(pairs: DataFrame, whole: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose whole sets (node, held) are similar."""

    def rows(b: dict) -> dict:
        keep = []
        for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist()):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(similar[1] * both >= similar[0] * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        return {"u": b["u"].filter(keep), "v": b["v"].filter(keep)}

    side = lambda node, held: whole.select(F.col("node").alias(node), F.col("held").alias(held))
    joined = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v").select("u", "v", "x", "y")
    return joined.mapInArrow(arrow_rows(rows, pa.schema([("u", pa.int64()), ("v", pa.int64())])), "u long, v long")


def sketch(held: bytes) -> np.ndarray:
    """Parities of the numbers of shingles at each place, as words of 64 bits."""
    places = (np.frombuffer(held, "<u8") >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=SKETCH_BITS) & 1, bitorder="little").view("<i8")


def _sketches(whole: DataFrame) -> DataFrame:
    """(node, one column for each word of its sketch)."""
    schema = pa.schema([("node", pa.int64()), *((c, pa.int64()) for c in _SKETCH)])

    def rows(b: dict) -> dict:
        words = np.array([sketch(x) for x in b["held"].to_pylist()], np.int64)
        return {"node": b["node"], **{c: words[:, i] for i, c in enumerate(_SKETCH)}}

    return whole.mapInArrow(arrow_rows(rows, schema), ", ".join(f"{c} long" for c in ("node", *_SKETCH)))


def _may_be_similar(similar: tuple[int, int]) -> Column:
    """Whether sketches (the second one's words end in v) leave it open that sets of n and m shingles are similar."""
    differ = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}v"))) for c in _SKETCH])
    return differ * sum(similar) <= (F.col("n") + F.col("m")) * (similar[1] - similar[0])


def _by_rare_shingles(open_: DataFrame, whole: DataFrame, similar: tuple[int, int], folder: str) -> DataFrame:
    """Pairs (u, v) of the sets (node, n, root) that have different roots and share a shingle among the rarest of both.

    A pair comes once, where its first common shingle stands, and again only where more than BEFORE shingles of one set lie between two
    that it shares.
    """

    def listed(b: dict) -> dict:
        return {"node": b["node"], "h": [np.frombuffer(x, "<i8") for x in b["held"].to_pylist()]}

    every = whole.mapInArrow(arrow_rows(listed, pa.schema([("node", pa.int64()), ("h", pa.list_(pa.int64()))])), "node long, h array<long>").select("node", F.explode("h").alias("h"))
    every = every.join(open_, "node")
    size = F.sum("part")
    meetings = every.groupBy("h", "root").agg(F.count(F.lit(1)).alias("part")).groupBy("h").agg((size * (size - F.max("part"))).alias("c"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("c", "h"))
    rare = every.join(meetings, "h").withColumn("k", rank).filter((F.col("k") <= F.col("n") - F.ceil(F.col("n") * similar[0] / similar[1]) + 1) & (F.col("c") > 0))
    rare = written(rare.select("h", "node", "n", "root", "k"), folder, "rare")
    parts = rare.groupBy("h", "root").agg(F.count(F.lit(1)).alias("part"))
    groups = parts.groupBy("h").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("part", "root")).alias("p")).filter("parts > 1").select("h", F.col("p.root").alias("main"))
    before = F.collect_list("h").over(Window.partitionBy("node").orderBy("k").rowsBetween(-BEFORE, -1))
    placed = rare.join(groups, "h").withColumn("before", before).join(written(_sketches(whole), folder, "sketches"), "node")
    placed = written(placed, folder, "rare-apart")
    # each set outside the largest part of a group meets all of the group
    other = {"node": "v", "n": "m", "root": "rv", **{c: f"{c}v" for c in ("k", "before", *_SKETCH)}}
    some = placed.filter("root <> main").select("h", *[F.col(c).alias(to) for c, to in other.items()])
    met = placed.join(some, "h").filter("root <> rv and (root = main or node < v)").filter(_near(similar)).filter(_enough_left(similar)).filter(_may_be_similar(similar))
    met = met.filter(~F.arrays_overlap("before", "beforev"))
    return met.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v"))


def _enough_left(similar: tuple[int, int]) -> Column:
    """Whether similar sets of n and m shingles may have the k-th of one and the kv-th of the other as the first in common."""
    return (F.least(F.col("n") - F.col("k"), F.col("m") - F.col("kv")) + 1) * sum(similar) >= (F.col("n") + F.col("m")) * similar[0]


def _near(similar: tuple[int, int]) -> Column:
    """Sizes n and m that sets of that similarity may have."""
    return F.least("n", "m") * similar[1] >= F.greatest("n", "m") * similar[0]


def near_copies(docs: DataFrame, text: str = "text", shingle_words: int = SHINGLE_WORDS, similar: tuple[int, int] = SIMILAR, radius: int = simhash.RADIUS) -> DataFrame:
    """(doc_id, text_hash, root) for every row: rows with one root are linked by pairs of similar shingle sets.

    Texts without words are alike. Repeated rows and null ids stay; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = shared_dir(spark)
    sets = written(_sets(docs, text, shingle_words), folder, "sets")
    near = _near(similar)
    # dealt by band once: buckets, pivots and their members come from the same exchange
    held = sets.select("node", "n", F.explode("bands").alias("h")).repartition("h")
    shared = held.groupBy("h").agg(F.min(F.struct("node", "n")).alias("p"), F.max("node").alias("high")).filter("p.node < high")
    met = written(held.join(shared.select("h", F.col("p.node").alias("pivot"), F.col("p.n").alias("m")), "h").distinct(), folder, "met")
    first = met.filter("node <> pivot").filter(near).groupBy(F.col("node").alias("u")).agg(F.min("pivot").alias("v"))
    first = written(_by_fingerprint(sets.select("node", "fp").distinct(), folder, radius).union(first).distinct(), folder, "first-pairs")
    # all sets that any pair below can hold: their texts are moved once
    nodes = first.select(F.col("u").alias("node")).union(first.select("v")).union(met.select("node")).distinct()
    whole = _whole(nodes, sets, docs, text, shingle_words, folder)
    check = lambda pairs, name: written(_checked(pairs, whole, similar), folder, f"{name}-links")
    links = check(first, "first")

    def apart(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """(h, node, n, root) of the buckets whose sets aren't all linked."""
        roots = components(links, f"{folder}/{name}-rounds")
        placed = rows.join(roots, "node", "left").select("h", "node", "n", F.coalesce("root", "node").alias("root"))
        placed = written(placed, folder, f"{name}-placed")
        several = placed.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("h")
        return written(placed.join(several, "h"), folder, f"{name}-apart")

    now = apart(met.select("h", "node", "n"), links, "one")
    ranked = now.join(now.groupBy("h", "root").agg(F.count(F.lit(1)).alias("part")), ["h", "root"])
    w = Window.partitionBy("h").orderBy("part", F.xxhash64("node"), "node")
    pivots = ranked.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= PIVOTS).select("h", F.col("node").alias("v"), F.col("n").alias("m"), F.col("root").alias("rv"))
    pivots = written(pivots, folder, "pivots")
    pairs = now.join(pivots, "h").filter("root <> rv").filter(near).select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()
    links = links.union(check(pairs, "second"))
    # a pivot was compared with all its bucket; what is apart without the pivots meets by rare shingles
    now = apart(now.join(pivots.select("h", F.col("v").alias("node")), ["h", "node"], "left_anti").select("h", "node", "n"), links, "two")
    if not now.isEmpty():
        open_ = now.select("node", "n", "root").distinct()
        links = links.union(check(_by_rare_shingles(open_, whole.join(open_, "node", "left_semi"), similar, folder).distinct(), "third"))
    roots = components(links, f"{folder}/last-rounds")
    named = sets.select("doc_id", "text_hash", "node").join(roots, "node", "left")
    return named.select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def representatives(docs: DataFrame, text: str = "text", shingle_words: int = SHINGLE_WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Documents that stand for their group of near copies, chosen as in simhash.representatives."""
    return chosen(docs, near_copies(docs, text, shingle_words, similar), text)
