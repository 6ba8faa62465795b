"""Shared parts of the pipeline operators: scratch space, package shipping, block grids."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: with texts of some kilobytes a batch stays within a few megabytes.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir.

    The setting is read from the session; only where it is unset (tests on one machine) a folder of our own is used.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file:///tmp/checkpoints/quire"
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet in a shared folder and reads them again."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


#: Most bits of a key filter: 8 MB are broadcast at most, however many keys there are.
FILTER_BITS = 26


def split_by_keys(rows: DataFrame, key: Column, keys: DataFrame, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(those that may be among the keys, those that aren't): the rows by whether a bit is set for the hash in `key`.

    keys has one column of 64-bit hashes, `k`. The filter takes about 32 bits a key up to 2 ** FILTER_BITS; beyond, more rows
    land in the first part, which the caller joins with the keys themselves, so the filter only saves moving rows. A null key
    counts as one that isn't among them.
    """
    size = 1 << min(FILTER_BITS, max(15, (32 * keys.count()).bit_length()))
    place = F.pmod("k", F.lit(size))
    placed = keys.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(32767).alias("at")).repartition("part")
    bits = F.broadcast(written(placed.groupBy("part").agg(F.bitmap_construct_agg("at").alias("held")), folder, name))
    place = F.pmod(key, F.lit(size))
    at = place.bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring(bits["held"], (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    met = rows.join(bits, F.shiftright(place, 15) == bits["part"], "left")
    columns = [rows[c] for c in rows.columns]
    return met.filter(hit).select(*columns), met.filter(~hit).select(*columns)


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Sends the package to the executors once, and keeps Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="quire-"), "quire_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def arrow_rows(
    f: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one over the columns of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(f({n: b.column(n) for n in b.schema.names}), schema=schema)

    return run


def utf8(column: pa.Array) -> list[bytes | None]:
    """The strings of an Arrow column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def vector_rows(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each vector as float64; None for one that is null or holds null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    ok = np.isfinite(flat)
    if values.null_count:
        ok &= values.is_valid().to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        a, b = starts[i], starts[i + 1]
        yield flat[a:b] if valid[i] and ok[a:b].all() else None


def block_grid(
    candidates: DataFrame,
    queries: DataFrame,
    n_candidates: int,
    n_queries: int,
    f: Callable,
    schema: str,
    candidate_block: int,
    query_block: int,
) -> DataFrame:
    """Every query block against every candidate block.

    Both sides have an `id` and are dealt by its hash to blocks of about the sizes given, so that no task holds more than
    one block of each and equal vectors don't meet in one block. f(key, candidates, queries) gets pandas frames.
    """
    n_c, n_q = max(1, -(-n_candidates // candidate_block)), max(1, -(-n_queries // query_block))
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = candidates.withColumn("cb", block(n_c, 1)).withColumn("qb", every(n_q))
    q = queries.withColumn("qb", block(n_q, 2)).withColumn("cb", every(n_c))
    return c.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb")).applyInPandas(f, schema)


def stacked(payloads) -> np.ndarray:
    """Packed vectors as a matrix of doubles; shorter ones are filled with zeros, which leave inner products as they are."""
    parts = [np.frombuffer(p, "<f8") for p in payloads]
    out = np.zeros((len(parts), max((len(p) for p in parts), default=0)))
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def best_per_query(found: DataFrame, score: str, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score): the k best of each query, ties to the smaller vec_id, with their rank."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score)


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, null taken as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
