"""Resume state over a stream of outcomes: the last outcome of a chunk wins, and a path is done when none of its chunks failed.

The state lives in the query's state store, keyed by path: a chunk's last run and whether it failed. A path that is done keeps its
state only until a timer ends it, so the store holds what is open and what was done lately, and old versions go with the store's
own clean-up. A replayed batch finds the state from before it and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "path string, chunk_ix long, run long, failed boolean"
MARKS = "path string, incomplete_chunks array<bigint>, n_chunks long, done boolean"
#: How long a path that is done is remembered.
KEEP_MS = 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State with a batch of outcomes (path, chunk_ix, run, failed): the highest run of each chunk."""
    both = state.unionByName(batch.select(*state.columns))
    return both.groupBy("path", "chunk_ix").agg(F.max(F.struct("run", "failed")).alias("r")).select("path", "chunk_ix", "r.run", "r.failed")


def incomplete(state: DataFrame) -> DataFrame:
    """(path, incomplete_chunks) of the paths that need another run."""
    return state.filter("failed").groupBy("path").agg(F.array_sort(F.collect_list("chunk_ix")).alias("incomplete_chunks"))


class Marker(StatefulProcessor):
    """A path's chunks; a row of MARKS for each batch that says something of it."""

    def __init__(self, keep_ms: int = KEEP_MS):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "chunk_ix long", "run long, failed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            for chunk, run, failed in zip(f["chunk_ix"].tolist(), f["run"].tolist(), f["failed"].tolist()):
                known = self.chunks.getValue((chunk,)) if self.chunks.containsKey((chunk,)) else None
                if known is None or (run, failed) >= tuple(known):
                    self.chunks.updateValue((chunk,), (run, failed))
        state = {k[0]: v for k, v in self.chunks.iterator()}
        open_ = sorted(k for k, (_, failed) in state.items() if failed)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not open_:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield pd.DataFrame({"path": [key[0]], "incomplete_chunks": [open_], "n_chunks": [len(state)], "done": [not open_]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.chunks.clear()
        return iter(())

    def close(self) -> None:
        pass


def marks(outcomes: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """A stream of MARKS, the state of each path after each batch that has outcomes of it."""
    conf = outcomes.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # timers would ask for batches without data for ever; they are looked at when outcomes come
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return outcomes.groupBy("path").transformWithStateInPandas(Marker(keep_ms), MARKS, "Update", "ProcessingTime")


def follow(outcomes: DataFrame, folder: str, keep_ms: int = KEEP_MS) -> StreamingQuery:
    """Writes the marks of a stream of outcomes below `folder`/marks, a folder for each batch; replaying a batch writes it again."""

    def step(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/marks/batch={n}")

    return marks(outcomes, keep_ms).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def latest(spark, folder: str) -> DataFrame:
    """The last mark of each path that follow has written."""
    rows = spark.read.option("basePath", f"{folder}/marks").parquet(f"{folder}/marks/*")
    return rows.groupBy("path").agg(F.max_by(F.struct("incomplete_chunks", "n_chunks", "done"), "batch").alias("m")).select("path", "m.*")
