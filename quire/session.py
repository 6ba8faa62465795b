"""Session helpers: table reading, tuned local sessions and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for a local or test session; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session with UTC time and few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quire")
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; one of our own where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints/quire"
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as Parquet in a scratch folder, read again: what depends on how rows were dealt is settled once."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def written_dealt(df: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """As written(), in buckets of the columns `by`: what groups, ranks or (under co_located) joins by them deals the rows no more.

    The rows are dealt for that unless they are already. Of the table only its files stay; its name leaves the catalogue at once.
    """
    spark = df.sparkSession
    folder, parts = scratch(spark), parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"quire_{uuid.uuid4().hex}"
    df.repartition(parts, *by).write.bucketBy(parts, *by).option("path", folder).format("parquet").saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Joins by more columns than those by which both sides are dealt already don't deal them again.

    The setting is read when a plan is made, so it only holds for what is written inside.
    """
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_shipped: set[str] = set()

#: Rows in one Arrow batch. A row may be a whole document, so a worker's memory follows the batch and not the size of a table.
BATCH_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, and keeps Arrow batches small: functions over them import it there."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="quire-"), "quire_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)
