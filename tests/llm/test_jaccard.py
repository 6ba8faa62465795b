"""Near copies of the pipeline against brute force over all pairs of shingle sets."""

import random

import corpus_pipeline
import pytest
from test_operators import documents

from quire.llm import jaccard


def brute(rows):
    """The smallest doc_id of each component of pairs with five-word Jaccard >= 0.8."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    label = list(range(len(rows)))
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and near(sets[i], sets[j]):
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    return sorted(min(d for (d, _), x in zip(rows, label) if x == y) for y in set(label))


def copies(groups, members, changes, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(900)]
    rows = [(1, "One"), (2, "one"), (3, "one two three four"), (4, "one two three four five"), (5, "a b " * 3000), (6, "b a " * 3000)]
    for g in range(groups):
        base = rnd.choices(words, k=rnd.randint(30, 200))
        for m in range(members):
            text = list(base)
            for _ in range(rnd.randint(0, changes * len(base) // 100)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((100 + 1000 * g + m, " ".join(text)))
    return rows


# small groups, and one in which every shingle is shared by more sets than are paired up at once
@pytest.mark.parametrize(("groups", "members", "changes"), [(25, 6, 6), (1, 120, 7)])
def test_no_near_copy_is_left(spark, groups, members, changes):
    rows = copies(groups, members, changes, groups)
    docs = documents(spark, [(d, t, "en", "s") for d, t in rows])
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "of and"), (3, "of and"), (3, "of and"), (4, "of and the")]
    docs = documents(spark, [(d, t, "en", "s") for d, t in rows])
    assert sorted(r.doc_id for r in jaccard.representatives(docs).collect()) == [1, 3, 4]
    assert jaccard.representatives(documents(spark, [])).count() == 0


def test_rare_shingles_bring_few_unlike_sets_together(spark, tmp_path):
    import numpy as np

    rnd = np.random.default_rng(1)
    words = rnd.integers(1 << 63, size=400, dtype=np.uint64) * np.uint64(2)
    sets = [np.sort(rnd.choice(words, 100, replace=False)) for _ in range(60)]
    sets.append(np.sort(np.concatenate([sets[0][:90], np.setdiff1d(words, sets[0])[:10]])))
    rows = [(i, x.tobytes(), len(x)) for i, x in enumerate(sets)]
    whole = spark.createDataFrame([(i, h) for i, h, _ in rows], "node long, held binary")
    open_ = spark.createDataFrame([(i, n, i) for i, _, n in rows], "node long, n long, root long")
    got = {(r.u, r.v) for r in jaccard._by_rare_shingles(open_, whole, (4, 5), str(tmp_path)).collect()}
    near = {(i, j) for j in range(61) for i in range(j) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert near == {(0, 60)} and near <= got and len(got) < 20


def test_sets_with_much_of_their_own_do_not_meet_at_what_they_share(spark, tmp_path):
    """Sketches tell nothing of sets as long as these: 67 in 100 shingles are alike in each pair, and a link needs 80."""
    import numpy as np

    rnd = np.random.default_rng(2)
    base = rnd.integers(1 << 63, size=1200, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base, rnd.integers(1 << 63, size=300, dtype=np.uint64)])) for _ in range(40)]
    sets.append(np.sort(np.concatenate([sets[0][:1400], rnd.integers(1 << 63, size=100, dtype=np.uint64)])))
    whole = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "node long, held binary")
    open_ = spark.createDataFrame([(i, len(x), i) for i, x in enumerate(sets)], "node long, n long, root long")
    got = [(r.u, r.v) for r in jaccard._by_rare_shingles(open_, whole, (4, 5), str(tmp_path)).collect()]
    assert (0, 40) in got and len(got) < 45
    assert len(got) == len(set(got))  # a pair comes once, not at each shingle that it shares
