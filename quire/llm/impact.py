"""Exact top-k inner products over an impact-ordered index, score at a time.

The non-zero components of a block's vectors are postings (vector, dimension, impact). Their sizes are quantised to levels, and the
posting lists stand in segments by descending level. Queries read the segments in that order and add up what each posting
contributes. After each segment the rest of a score is bounded: no more than the length of the query times the length of what
the vector has left (Cauchy-Schwarz). A query stops once that proves that few vectors can be among its best; those are scored
exactly. Queries that get no such proof read on to the last segment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, best_per_query, block_grid, prepare, shared_dir, stacked, vector_rows, written

K = 5
SCALE = 256
QUERY_STEP = 50
CANDIDATE_BLOCK = 2048
QUERY_BLOCK = 4096
#: Levels that impacts are quantised to, and the shares of all postings after which a segment ends (at the end of a level).
LEVELS = 64
SHARES = (0.15, 0.3, 0.5, 0.7)
#: Queries that read the segments together.
BATCH = 64
#: Up to this length of both vectors all sums are integers that doubles hold; pairs with a longer one are scored as whole numbers.
MOST_LENGTH = 2.0**25
LONG = (-(1 << 63), (1 << 63) - 1)
#: A query stops when at most this share of a block can be among its best.
FEW = 0.05

SCHEMA = "query_id long, vec_id long, score long"


class ImpactIndex:
    """Impact-ordered segments of posting lists of one block of vectors with integer components."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS, shares=SHARES) -> None:
        self.vectors = vectors
        size = np.abs(vectors)
        level = np.ceil(size * (levels / max(1.0, size.max(initial=0)))).astype(np.int64)
        vec, dim = np.nonzero(vectors)
        order = np.lexsort((dim, vec, -level[vec, dim]))
        vec, dim = vec[order], dim[order]
        by_level = -level[vec, dim]
        cuts = {int(np.searchsorted(by_level, by_level[int(len(vec) * x)], "right")) for x in shares if len(vec)}
        self.segments: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.left: list[np.ndarray] = []
        rest = (vectors**2).sum(1)
        for a, b in zip(sorted({0, *cuts} - {len(vec)}), [*sorted(cuts - {0, len(vec)}), len(vec)]):
            at = a + np.argsort(vec[a:b], kind="stable")
            ids, starts = np.unique(vec[at], return_index=True)
            impact = vectors[vec[at], dim[at]]
            self.segments.append((ids, starts, dim[at], impact))
            if len(ids):
                rest[ids] -= np.add.reduceat(impact**2, starts)
            self.left.append(np.sqrt(np.maximum(rest, 0)))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, vector, exact score) that hold the k best of each query; own[q, v] marks pairs that don't count."""
        n_q, n = own.shape
        alive, acc = np.arange(n_q), np.zeros((n_q, n))
        length = np.sqrt((queries**2).sum(1))
        out: list[tuple] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for i, ((ids, starts, dim, impact), left) in enumerate(zip(self.segments, self.left)):
            if len(ids):
                acc[:, ids] += np.add.reduceat(queries[alive][:, dim] * impact, starts, axis=1)
            rest = length[alive][:, None] * left[None, :]
            low = np.where(own[alive], -np.inf, acc - rest)
            bound = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(alive), -np.inf)
            possible = (acc + rest >= bound[:, None] - 1e-6 * (1 + np.abs(bound[:, None]))) & ~own[alive]
            done = (possible.sum(1) <= max(4 * k, FEW * n)) | (i == len(self.segments) - 1)
            q, v = np.nonzero(possible[done])
            q = alive[done][q]
            out.append((q, v, np.einsum("ij,ij->i", queries[q], self.vectors[v])))
            alive, acc = alive[~done], acc[~done]
            if not len(alive):
                break
        return tuple(np.concatenate(x) for x in zip(*out))


def _whole_score(a: np.ndarray, b: np.ndarray) -> int:
    """Inner product in whole numbers of any size, cut to the range of a long."""
    return min(max(sum(int(x) * int(y) for x, y in zip(a, b)), LONG[0]), LONG[1])


def block_best(key, candidates: pd.DataFrame, queries: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """The k best of a block for each query of another; rows of one id count as one, with the best of their scores."""
    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
    if not len(candidates) or not len(queries):
        return empty
    v, q = (stacked([np.frombuffer(p, "<f8" if w else "<i2").astype("<f8").tobytes() for p, w in zip(side["payload"], side["wide"])]) for side in (candidates, queries))
    dims = max(v.shape[1], q.shape[1])
    v, q = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (v, q))
    ids, qids = candidates["id"].to_numpy(np.int64), queries["id"].to_numpy(np.int64)
    long_v, long_q = (np.sqrt((x**2).sum(1)) > MOST_LENGTH for x in (v, q))
    usual_v, usual_q, found = np.flatnonzero(~long_v), np.flatnonzero(~long_q), [empty]
    once = len(np.unique(ids)) == len(ids)
    index = ImpactIndex(v[usual_v])
    for a in range(0, len(usual_q), BATCH):
        some = usual_q[a : a + BATCH]
        own = qids[some, None] == ids[None, usual_v]
        # several rows of one id could fill the k places: then all of a block are possible members
        i, j, s = index.search(q[some], own, k if once else len(usual_v))
        best = pd.DataFrame({"query_id": qids[some][i], "vec_id": ids[usual_v][j], "score": s.astype(np.int64)})
        found.append(_best(best, k))
    pairs = [(i, j) for i in np.flatnonzero(long_q) for j in range(len(v))] + [(i, j) for i in usual_q for j in np.flatnonzero(long_v)]
    if pairs:
        rows = [(qids[i], ids[j], _whole_score(q[i], v[j])) for i, j in pairs if qids[i] != ids[j]]
        found.append(pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(np.int64))
    return _best(pd.concat(found), k)


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
    return found.groupby("query_id").head(k)


def packed_integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, payload, wide): floor(scale * component) of each valid vector, as 16-bit integers or else doubles, repeats once."""

    def rows(b: dict) -> dict:
        ids, payload, wide = [], [], []
        for i, v in zip(b["id"].to_pylist(), vector_rows(b["embedding"])):
            if v is not None and i is not None:
                x = np.clip(np.floor(scale * v), -1e150, 1e150) + 0.0
                big = bool(np.abs(x).max(initial=0) >= 2**15)
                ids.append(i)
                payload.append(x.astype("<f8" if big else "<i2").tobytes())
                wide.append(big)
        return {"id": ids, "payload": payload, "wide": wide}

    schema = pa.schema([("id", pa.int64()), ("payload", pa.binary()), ("wide", pa.bool_())])
    read = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>"))
    return read.mapInArrow(arrow_rows(rows, schema), "id long, payload binary, wide boolean").distinct()


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, query_step: int = QUERY_STEP, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector whose id is divisible by query_step, its k highest inner products.

    Components are floor(scale * x), scores are exact integers; one beyond a long is given as the end of a long's range that it lies
    past. Ties go to the smaller vec_id; fewer than k others give fewer rows. Vectors that are null or hold null or non-finite components, and those with a null id, take
    no part. Missing components of a shorter vector count as zero. Rows equal in id and vector count once; rows of one id with
    different vectors are one query, each of them compared, that never finds itself. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = written(packed_integers(vectors, scale), shared_dir(spark), "vectors")
    queries = rows.filter(F.col("id") % query_step == 0)
    n, n_q = rows.count(), queries.count()
    grid = block_grid(rows, queries, n, n_q, lambda key, c, q: block_best(key, c, q, k), SCHEMA, candidate_block, query_block)
    return best_per_query(grid.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "score", k)


def oracle(k: int = K, scale: int = SCALE, query_step: int = QUERY_STEP) -> str:
    """The same as DuckDB SQL, by scoring all pairs (for tables where that is feasible)."""
    return f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {query_step} = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
