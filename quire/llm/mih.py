"""Nearest neighbours by multi-index hashing over learned binary codes.

Codes are the signs of a rotation that is learned from a bounded sample (principal axes, then alternating with the nearest codes,
so that little is lost by quantising). A code is cut into substrings, each with its own table of buckets. Codes within Hamming
radius r of a query agree with it on some substring up to floor(r / substrings) bits, so probing the buckets of each table up to that
distance retrieves all of them; what is found is checked on the whole code, and the vectors themselves give the scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, best_per_query, block_grid, prepare, shared_dir, stacked, vector_rows, written

K = 20
QUERY_STEP = 20
BITS = 128
SUBSTRING_BITS = 16
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 4096
#: Rows of the sample that rotation and radius are learned from, chosen by hash; all rows are indexed.
SAMPLE_ROWS = 8000
SAMPLE_QUERIES = 200
#: Share of the sample's true neighbours that the radius has to take in.
REACH = 0.96
#: Share of the vectors whose length the bound of the codes takes in; the longer ones are scanned.
BOUND_SHARE = 0.99

SCHEMA = "query_id long, vec_id long, score double"


class Codes:
    """A learned map from vectors to binary codes, with the radius that takes in most true neighbours."""

    def __init__(self, sample: np.ndarray, longest: float, bits: int = BITS, k: int = K, reach: float = REACH) -> None:
        self.longest, self.dims = longest, sample.shape[1]
        sample = sample[~self.beyond(sample)]
        rng = np.random.default_rng(5)
        x = self.lifted(sample)
        self.mean = x.mean(0) if len(x) else np.zeros(self.dims + 1)
        parts = []
        x = x - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        for _ in range(0, bits, 64):
            d = min(64, x.shape[1])
            v = np.zeros((len(x), 64))
            v[:, :d] = x @ axes[:, ::-1][:, :d]
            turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
            for _ in range(30):
                u, _, vt = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
                turn = (u @ vt).T
            parts.append(axes[:, ::-1][:, :d] @ turn[:d])
        self.turn = np.hstack(parts)
        self.radius = bits
        if len(sample) > 2 * k:
            some = np.arange(min(SAMPLE_QUERIES, len(sample)))
            s = sample[some] @ sample.T
            s[some, some] = -np.inf
            near = np.argpartition(-s, k, axis=1)[:, :k]
            apart = np.bitwise_count(self(sample[some], query=True)[:, None, :] ^ self(sample)[near]).sum(-1)
            self.radius = int(np.quantile(apart, reach, method="higher"))

    def beyond(self, x: np.ndarray) -> np.ndarray:
        """Vectors that are longer than the bound: codes don't cover them."""
        return (x**2).sum(1) > self.longest**2

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One more dimension turns the largest inner product into the smallest distance; a query's length doesn't matter."""
        if query:
            x = x * (self.longest / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
        fill = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.longest**2 - (x**2).sum(1)))
        return np.hstack([x, fill[:, None]])

    def __call__(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, max(0, self.dims - x.shape[1]))))[:, : self.dims]
        signs = (self.lifted(x, query) - self.mean) @ self.turn > 0
        return np.packbits(signs, axis=1).view("<u8")


class MultiIndex:
    """One table of buckets per substring, over the codes of a block."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.tables = []
        for part in codes.view("<u2").T:
            keys, inverse = np.unique(part, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            self.tables.append((keys, order, np.searchsorted(inverse[order], np.arange(len(keys) + 1))))

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, code) within the radius: all of them, by the pigeonhole argument."""
        found = np.zeros((len(query), len(self.codes)), bool)
        reach = radius // len(self.tables)
        for (keys, order, starts), part in zip(self.tables, np.ascontiguousarray(query).view("<u2").T):
            q, bucket = np.nonzero(np.bitwise_count(part[:, None] ^ keys[None, :]) <= reach)
            n = starts[bucket + 1] - starts[bucket]
            at = np.repeat(starts[bucket] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
            found[np.repeat(q, n), order[at]] = True
        q, c = np.nonzero(found)
        apart = np.bitwise_count(query[q] ^ self.codes[c]).sum(1)
        return q[apart <= radius], c[apart <= radius]


def block_nearest(candidates: pd.DataFrame, queries: pd.DataFrame, codes: Codes, k: int) -> pd.DataFrame:
    """The k best of a block for each query, among the codes within the radius (widened where they are too few)."""
    if not len(candidates) or not len(queries):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    v, q = stacked(candidates["payload"]), stacked(queries["payload"])
    dims = max(v.shape[1], q.shape[1])
    v, q = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (v, q))
    ids, qids = candidates["id"].to_numpy(np.int64), queries["id"].to_numpy(np.int64)
    index, found = MultiIndex(codes(v)), []
    long = codes.beyond(v)  # scored with every query
    for a in range(0, len(q), 128):
        todo, radius = np.arange(a, min(a + 128, len(q))), codes.radius
        while len(todo):
            i, j = index.within(codes(q[todo], query=True), radius)
            coded = ~long[j]
            at, all_long = np.arange(len(todo)), np.flatnonzero(long)
            i = np.concatenate([i[coded], np.repeat(at, len(all_long))])
            j = np.concatenate([j[coded], np.tile(all_long, len(at))])
            other = qids[todo][i] != ids[j]
            i, j = i[other], j[other]
            enough = np.bincount(i[~long[j]], minlength=len(todo)) >= k
            if radius >= codes.turn.shape[1]:
                enough[:] = True
            use = enough[i]
            i, j = todo[i[use]], j[use]
            for b in range(0, len(i), 200_000):
                s = (q[i[b : b + 200_000]] * v[j[b : b + 200_000]]).sum(1)
                found.append(pd.DataFrame({"query_id": qids[i[b : b + 200_000]], "vec_id": ids[j[b : b + 200_000]], "score": s}))
            if found:
                best = pd.concat(found).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                found = [best.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)]
            todo, radius = todo[~enough], min(codes.turn.shape[1], radius + 2 * len(index.tables))
    return pd.concat(found) if found else block_nearest(candidates[:0], queries, codes, k)


def packed_floats(vectors: DataFrame) -> DataFrame:
    """(id, payload, norm) of each valid vector, repeats once; zero vectors take no part."""

    def rows(b: dict) -> dict:
        ids, payload, norm = [], [], []
        for i, v in zip(b["id"].to_pylist(), vector_rows(b["embedding"])):
            if v is not None and i is not None and v.any():
                ids.append(i)
                payload.append(v.astype("<f8").tobytes())
                norm.append(float(np.linalg.norm(v)))
        return {"id": ids, "payload": payload, "norm": norm}

    schema = pa.schema([("id", pa.int64()), ("payload", pa.binary()), ("norm", pa.float64())])
    read = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>"))
    return read.mapInArrow(arrow_rows(rows, schema), "id long, payload binary, norm double").distinct()


def nearest(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector whose id is divisible by query_step, the k largest inner products found.

    Rotation and radius are learned from about sample_rows vectors; every vector is indexed. Ties go to the smaller vec_id; a query
    finds as many as there are up to k, since its radius is widened until it has k or all. Vectors that are null, zero or hold null
    or non-finite components, and those with a null id, take no part. Missing components of a shorter vector count as zero. Rows
    equal in id and vector count once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = written(packed_floats(vectors), shared_dir(spark), "vectors")
    queries = rows.filter(F.col("id") % query_step == 0)
    n, n_q, longest = *rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") % query_step == 0, 1)), F.percentile_approx("norm", BOUND_SHARE, 10_000)).first(),
    share = int(min(1.0, sample_rows / max(1, n)) * (1 << 30))
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) < share).orderBy("id").limit(2 * sample_rows).select("payload").collect()
    codes = spark.sparkContext.broadcast(Codes(stacked([r.payload for r in sample]), (longest or 1.0) * (1 + 1e-9), k=k))
    block = lambda key, c, q: block_nearest(c, q, codes.value, k)
    grid = block_grid(rows.drop("norm"), queries.drop("norm"), n, n_q, block, SCHEMA, candidate_block, query_block)
    return best_per_query(grid.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "score", k)
