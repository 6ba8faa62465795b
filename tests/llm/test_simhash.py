"""SimHash fingerprints and links against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from quire.llm import simhash

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """(doc_id, fingerprint, component) by plain loops over all pairs."""
    fps = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((str(d), f"{fps[i]:016x}", str(low.get(find(i)))) for i, (d, _) in enumerate(rows))


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DDL).withColumnRenamed("lang", "fp")
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df).collect())


def test_components_equal_brute_force_with_odd_rows(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdeéç", k=5)) for _ in range(200)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one  TWO"), (6, "one two three"), (7, "ÀB c d"), (None, "one two three"), (6, "one two three"), (8, "x " * 30000)]
    for i in range(60):
        base = rnd.choices(words, k=rnd.randint(5, 400))
        rows.append((100 + 3 * i, " ".join(base)))
        base[rnd.randrange(len(base))] = "changed"
        rows.append((101 + 3 * i, "\n".join(base)))
        rows.append((102 + 3 * i, " ".join(base).upper()))
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("spread", [4, 10, 64])
def test_gray_index_finds_every_pair(spread):
    rng = np.random.default_rng(spread)
    fps = np.zeros(700, np.uint64)
    for _ in range(8):  # near and far fingerprints
        fps ^= np.uint64(1) << rng.integers(0, spread, 700).astype(np.uint64)
    fps = np.unique(fps)
    q, c = simhash.GrayIndex(fps).search(fps, 3)
    want = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    got = np.zeros_like(want)
    got[q, c] = True
    assert (got == want).all()
    assert len(q) == want.sum()


def test_hot_segment_value_is_split_and_loses_no_link(spark):
    rng = np.random.default_rng(3)
    fps = sorted({int(x) << 16 | int(y) for x, y in zip(rng.integers(0, 4, 900), rng.integers(0, 1 << 16, 900))})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from quire.llm.common import shared_dir
    from quire.llm.graph import components

    folder = shared_dir(spark)
    got = {r.node: r.root for r in components(simhash.links(df, folder, bin_rows=64), folder).collect()}
    arr = np.array(fps)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 3
    label = np.arange(len(arr))
    for _ in range(len(arr)):
        new = np.where(near, label[None, :], len(arr)).min(1)
        if (new == label).all():
            break
        label = new
    assert [got.get(f, f) for f in fps] == [fps[i] for i in label]


def test_long_path_of_links(spark):
    from quire.llm.common import shared_dir
    from quire.llm.graph import components

    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges, shared_dir(spark)).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_of_repeated_rows_the_first_in_the_order_of_all_columns_stays(spark):
    from pyspark.sql import functions as F

    from quire.llm import simhash

    rows = [(1, "a b c d", "en", "s2"), (1, "a b c d", "en", "s1"), (1, "a b c d", None, "s0"), (2, "a b c d", "en", "s0"), (3, "p q r s t", "de", "s"), (3, "p q r s t", "de", "s"), (None, None, "x", "y"), (None, None, "x", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64("text").alias("root"))
    kept = sorted(map(tuple, simhash.chosen(docs.repartition(3), found).collect()), key=str)
    assert kept == [(1, "a b c d", "en", "s1"), (3, "p q r s t", "de", "s"), (None, None, "x", "y")]
