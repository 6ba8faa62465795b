"""SimHash near-duplicates: fingerprints of word shingles, linked through a Gray-order hierarchical index.

A fingerprint table of any size is dealt to bins of bounded size: two fingerprints that differ in at most three bits agree on
one of four 16-bit segments, so each goes to the bins of its four segment values. In a bin the fingerprints are sorted by
Gray rank; runs of neighbours form a node, which keeps the bits that they share (mask and pattern); nodes of nodes keep the
shared bits in turn, and only the bits that their parent doesn't hold. A search adds up the differences from the top node
down and drops a whole group as soon as they exceed the radius.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, prepare, shared_dir, split_by_keys, utf8, written
from .graph import components

SHINGLE_WORDS = 3
RADIUS = 3
SEGMENTS = 4
#: Fingerprints in a bin or in half of a pair of blocks.
BIN_ROWS = 4096
FANOUT = 16
SEED = 42
#: Hot segment values are broadcast up to so many rows (16 bytes each); beyond, they are joined by a shuffle.
MOST_BROADCAST = 50_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def shingle_hashes(text: bytes | None, shingle_words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included: A-Z lower-cased, words split at the six ASCII white-space characters.

    A text of fewer words is one shingle; one without words has none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle_words + 1)
    hashes = (digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[min(shingle_words, len(words)) - 1 :]))
    return np.fromiter(hashes, np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash: a bit is 1 if set in over half of the hashes."""
    n = len(hashes)
    # one histogram over (byte place, byte value) gives all 64 bit counts
    counts = np.bincount((hashes.view(np.uint8).reshape(n, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * counts > n).ravel(), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text; zero for one without words."""
    return majority(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long, and a hash that tells texts of one id apart."""
    prepare(docs.sparkSession)

    def rows(b: dict) -> dict:
        fps = [fingerprint(t, shingle_words) for t in utf8(b["text"])]
        return {"doc_id": b["doc_id"], "text_hash": b["text_hash"], "fp": np.array(fps, np.uint64).view(np.int64)}

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return read.mapInArrow(arrow_rows(rows, schema), "doc_id long, text_hash long, fp long")


class GrayIndex:
    """Gray-order hierarchical index over distinct 64-bit fingerprints."""

    def __init__(self, fps: np.ndarray, fanout: int = FANOUT) -> None:
        rank = fps.copy()
        for shift in (1, 2, 4, 8, 16, 32):  # the rank of a Gray code is the prefix XOR of its bits
            rank ^= rank >> np.uint64(shift)
        self.order = np.argsort(rank, kind="stable")
        pattern, mask = fps[self.order], np.full(len(fps), 2**64 - 1, np.uint64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(pattern, mask)]
        self.fanout = fanout
        while len(pattern) > fanout:
            starts = np.arange(0, len(pattern), fanout)
            first = np.repeat(pattern[starts], np.diff([*starts, len(pattern)]))
            differ = np.bitwise_or.reduceat((pattern ^ first) | ~mask, starts)
            pattern, mask = pattern[starts], ~differ
            self.levels.append((pattern, mask))
        # a node tests only the bits that its parent doesn't hold
        for i in range(len(self.levels) - 1):
            p, m = self.levels[i]
            above = np.repeat(self.levels[i + 1][1], fanout)[: len(p)]
            self.levels[i] = (p, m & ~above)

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, fingerprint position) that differ in at most `radius` bits."""
        p, m = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(p))
        node = np.tile(np.arange(len(p)), len(queries))
        spent = np.zeros(len(q), np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            p, m = self.levels[depth]
            spent = spent + np.bitwise_count((queries[q] ^ p[node]) & m[node])
            keep = spent <= radius
            q, node, spent = q[keep], node[keep], spent[keep]
            if depth:
                below = len(self.levels[depth - 1][0])
                child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                q, spent = np.repeat(q, self.fanout), np.repeat(spent, self.fanout)
                there = child < below
                q, node, spent = q[there], child[there], spent[there]
        return q, self.order[node]


def _roots(n: int, chunks) -> np.ndarray:
    """Smallest position that each of n positions reaches over the pairs in chunks."""
    root = np.arange(n)
    for a, b in chunks:
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            low = np.minimum(ra, rb)
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while (root != (step := root[root])).any():
                root = step
    return root


def bin_links(fps: np.ndarray, radius: int = RADIUS, fanout: int = FANOUT, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep a bin connected as all its pairs within the radius would: (fingerprint, smallest of its group)."""
    fps = np.unique(fps.view(np.uint64))
    index = GrayIndex(fps, fanout)

    def pairs():
        for i in range(0, len(fps), chunk):
            q, c = index.search(fps[i : i + chunk], radius)
            yield q + i, c

    root = _roots(len(fps), pairs())
    moved = root != np.arange(len(fps))
    return fps[moved].view(np.int64), fps[root[moved]].view(np.int64)


def links(distinct: DataFrame, folder: str, radius: int = RADIUS, segments: int = SEGMENTS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (fp) whose components are those of all pairs within the radius.

    Bins hold whole segment values. A segment value with more than bin_rows fingerprints is dealt to blocks by hash, and
    each pair of blocks is a bin of its own: the work on a hot value is spread, and no fingerprint is dropped.
    """
    if segments <= radius or 64 % segments:
        raise ValueError("needs more segments than the radius, dividing 64 evenly")
    width = 64 // segments
    spark = distinct.sparkSession
    n = distinct.count()
    bins = max(1, -(-n * segments // bin_rows))
    part = F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), F.expr(f"shiftrightunsigned(fp, {width * i}) & {(1 << width) - 1}L").alias("val")) for i in range(segments)]))
    dealt = distinct.select("fp", part.alias("p")).select("fp", "p.seg", "p.val")
    hot = written(dealt.groupBy("seg", "val").count().filter(F.col("count") > bin_rows), folder, "hot")
    n_hot = hot.count()
    plain = [F.lit("bin").alias("kind"), F.lit(0).alias("seg"), F.pmod(F.xxhash64("seg", "val"), F.lit(bins)).alias("val"), F.lit(0).alias("a"), F.lit(0).alias("b")]
    if n_hot:
        joined = dealt.join(F.broadcast(hot) if n_hot <= MOST_BROADCAST else hot, ["seg", "val"], "left")
        blocks = F.ceil(F.col("count") * 2 / bin_rows).cast("int")
        mine = F.pmod(F.xxhash64("fp", F.lit(5)), blocks).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks - 1))
        split = joined.filter("count is not null").select("fp", "seg", "val", mine.alias("mine"), other.alias("other"))
        split = split.select("fp", F.lit("pair").alias("kind"), "seg", "val", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
        binned = joined.filter("count is null").select("fp", *plain).union(split)
    else:
        binned = dealt.select("fp", *plain)

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = bin_links(pdf["fp"].to_numpy(np.int64), radius)
        return pd.DataFrame({"u": u, "v": v})

    return binned.groupBy("kind", "seg", "val", "a", "b").applyInPandas(found, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash, root) for every row; root is the smallest fingerprint of the component.

    A null text counts as one without words: fingerprint zero, linked like any other. Repeated rows stay, each with the same
    component. A null doc_id stays and never names a component unless all of its members are null. An empty table gives no
    rows. Columns besides doc_id and the text are not read, whatever their names.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    fps = written(fingerprints(docs, text, shingle_words), folder, "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), folder, "classes")
    roots = components(links(classes.select("fp"), folder, radius), folder)
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id", "root")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(by_fp, "fp").select("doc_id", digits.alias("fingerprint"), "component_id", "text_hash", "root")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """Documents that stand for their group of near copies: that with the smallest doc_id (then the smallest hash of its text).

    A null id comes last, so a group without any id keeps one of its rows too. Equal rows are kept once. Columns are those of docs.
    """
    return chosen(docs, near_duplicates(docs, **options), options.get("text", "text"))


def chosen(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that stand for their root in found (doc_id, text_hash, root).

    Only rows that a filter can't tell from dropped ones are moved to the join with the chosen keys. Of rows with one id and text that
    stays which comes first when all columns are written as JSON.
    """
    folder = shared_dir(docs.sparkSession)
    found = written(found, folder, "found")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    keep = written(best.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash")), folder, "representatives")
    same = found["doc_id"].eqNullSafe(keep["_id"]) & (found["text_hash"] == keep["_hash"])
    dropped = written(found.join(keep, same, "left_anti").select(F.xxhash64("doc_id", "text_hash").alias("k")), folder, "dropped")
    id_, hashed = docs["doc_id"].cast("long"), F.xxhash64(docs[text])
    unsure, sure = split_by_keys(docs, F.xxhash64(id_, hashed), dropped, folder, "dropped-bits")
    # an inner join: a semi-join would be pushed below the filter and move every text
    among = unsure["doc_id"].cast("long").eqNullSafe(keep["_id"]) & (F.xxhash64(unsure[text]) == keep["_hash"])
    kept = sure.unionByName(unsure.join(keep, among).select(*[unsure[c] for c in docs.columns]))
    # rows of one id and text: the first in the order of all columns stays; only rows of such keys are moved
    stays = found.join(keep, same, "left_semi").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    repeated = written(stays.filter("n > 1").select(F.xxhash64("doc_id", "text_hash").alias("k")), folder, "repeated")
    unsure, single = split_by_keys(kept, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text)), repeated, folder, "repeated-bits")
    order = Window.partitionBy("doc_id", F.xxhash64(text)).orderBy(F.to_json(F.struct(*docs.columns)))
    first = unsure.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return single.unionByName(first)
