"""Resume state in a stream: several runs, late and repeated outcomes, a replayed batch, and state that ends."""

import os
import shutil

from quire.streaming import resume

OUTCOMES = [
    [("p", 1, 1, True), ("p", 2, 1, False), ("q", 1, 1, True)],
    [("p", 1, 2, False), ("p", 1, 1, True), ("q", 1, 1, True)],
    [("q", 1, 3, False), ("q", 1, 2, True), ("r", 5, 1, True), ("r", 5, 1, False)],
]


def add(spark, tmp_path, n):
    spark.createDataFrame(OUTCOMES[n], resume.OUTCOME).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")


def run(spark, tmp_path, **kw):
    stream = spark.readStream.schema(resume.OUTCOME).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = resume.follow(stream, str(tmp_path / "out"), **kw)
    query.awaitTermination()
    return query


def told(spark, tmp_path):
    return {r.path: (list(r.incomplete_chunks), r.n_chunks, r.done) for r in resume.latest(spark, str(tmp_path / "out")).collect()}


def test_runs_and_replay(spark, tmp_path):
    add(spark, tmp_path, 0)
    run(spark, tmp_path)
    assert told(spark, tmp_path) == {"p": ([1], 2, False), "q": ([1], 1, False)}
    add(spark, tmp_path, 1)
    run(spark, tmp_path)
    assert told(spark, tmp_path) == {"p": ([], 2, True), "q": ([1], 1, False)}
    # the last batch is lost before it was committed: it runs again on the state from before it
    before = told(spark, tmp_path)
    commits = f"{tmp_path}/out/checkpoint/commits"
    os.remove(f"{commits}/1")
    if os.path.exists(f"{commits}/.1.crc"):
        os.remove(f"{commits}/.1.crc")
    shutil.rmtree(f"{tmp_path}/out/marks/batch=1")
    run(spark, tmp_path)
    assert told(spark, tmp_path) == before
    add(spark, tmp_path, 2)
    run(spark, tmp_path)
    state = told(spark, tmp_path)
    assert state["q"] == ([], 1, True) and state["r"][1] == 1
    batch = spark.createDataFrame([x for b in OUTCOMES[:2] for x in b], resume.OUTCOME)
    assert [(r.path, r.incomplete_chunks) for r in resume.incomplete(resume.merged(batch.limit(0), batch)).collect()] == [("q", [1])]


def test_what_is_done_leaves_the_store(spark, tmp_path):
    add(spark, tmp_path, 1)
    run(spark, tmp_path, keep_ms=0)
    assert told(spark, tmp_path)["p"] == ([1], 1, False) or told(spark, tmp_path)["p"][2]
    spark.createDataFrame([("z", 1, 1, True)], resume.OUTCOME).coalesce(1).write.parquet(f"{tmp_path}/in/z")
    run(spark, tmp_path, keep_ms=0)
    spark.createDataFrame([("z", 2, 1, True)], resume.OUTCOME).coalesce(1).write.parquet(f"{tmp_path}/in/zz")
    query = run(spark, tmp_path, keep_ms=0)
    rows = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert rows <= 8
