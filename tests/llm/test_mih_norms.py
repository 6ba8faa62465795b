"""Recall of the multi-index search where vectors differ in length."""

import numpy as np
import pytest

from quire.llm import mih


@pytest.mark.parametrize("kind", ["outlier", "spread"])
def test_recall_with_unequal_norms(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rng.uniform(0.5, 1.5, (2000, 1)) if kind == "spread" else np.where(np.arange(2000) == 7, 10.0, 1.0)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {(r.query_id, r.vec_id) for r in mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = {(q, int(v)) for q in range(0, 2000, 20) for v in np.argsort(-s[q])[:20]}
    assert len(got & want) / len(want) >= 0.9
