"""Conversation repair against plain search, with odd rows: nulls, empty and blank texts, ties, repeats, long conversations, no rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np

from quire.llm import registry, repair

SF = "/root/testdata/sf0.01"
DDL = "conv_id long, turn long, role string, text string, state string, cost int"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) by a search over all edits."""
    faults, seen = [], set()
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, put):
        """The least (cost, letters, repaired) from turn i on; at most two inserts in a row can be of use."""
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        want = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
        after = STEP[state, want[0]]
        if put < 2:
            c, a, r = best(i, after, put + 1)
            options.append((c + 2, "I" + a, ((want, ""), *r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, state, 0)
            options.append((c + 3, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                c, a, r = best(i + 1, after, 0)
                options.append((c + 2 + extra, "R" + a, ((want, text), *r)))
                if (state, role[:1]) in STEP:
                    c, a, r = best(i + 1, STEP[state, role[:1]], 0)
                    options.append((c + extra, "K" + a, ((role, text), *r)))
        return min(options, default=(10**9, "", ()))

    cost, audit, out = best(0, 0, 0)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), out


def test_every_conversation_of_the_table(spark):
    """The registered query against the plain search, over the whole table."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in registry.queries()["op11_repair"](spark, SF).collect()}
    assert got == {c: plain(tuple(r))[0] for c, r in damage(rows).items()}


def test_random_and_odd_conversations(spark):
    rnd = random.Random(3)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None, "sys", "U"]
    texts = ["Yes.", "No", "", " \n\x0b", None, "Why?", "Why?", "x" * 3000 + " ", "é… ", "one. \t"]
    rows = [(rnd.choice([None, *range(90)]), rnd.choice([None, *range(8)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(900)]
    rows += [rows[5], rows[6], (900, 2**62, "user", "Hi."), (900, -(2**61), "assistant", "Ho."), *((901, t, rnd.choice(roles), rnd.choice(texts)) for t in range(300))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL)
    want = {c: plain(tuple(r)) for c, r in damage(rows).items()}
    found = repair.audited(repair.damaged(df.repartition(5))).collect()
    assert len(found) == len(want)
    assert {r[0]: tuple(r)[1:] for r in found} == {c: w[0] for c, w in want.items()}
    turns = {}
    for r in sorted(repair.repaired(repair.damaged(df)).collect(), key=lambda r: r.position):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert {c: tuple(t) for c, t in turns.items()} == {c: w[1] for c, w in want.items() if w[1]}


def test_small_batches_change_nothing(spark, monkeypatch):
    rows = [(i % 40, i // 40, "user" if i % 3 else "assistant", f"turn {i % 7}{'.' * (i % 2)}") for i in range(800)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(tuple, repair.audited(repair.whole(df)).collect()))
    monkeypatch.setattr(repair, "BATCH_TURNS", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    split = repair._stream(repair.whole(df)).mapInArrow(repair._digests, repair.DIGESTS)
    assert sorted(map(tuple, split.collect())) == whole
    assert [w[1:] for w in whole] == [plain(tuple(r))[0] for _, r in sorted(by_conv(rows).items())]


def by_conv(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t, r, x))
    return {c: sorted(v) for c, v in out.items()}


def test_no_rows_and_nothing_left(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.audited(repair.damaged(empty)).count() == 0 == repair.repaired(repair.whole(empty)).count()
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = repair.audited(repair.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(x) for x in r] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_long_conversation_is_solved_whole():
    rnd = np.random.default_rng(1)
    codes = rnd.choice(np.array([0, 1, 2, 3, 1 | repair.GONE, 2 | repair.CUT], np.uint8), (20000, 1))
    x = repair.traces(codes, np.array([20000]))[0]
    letters = {k: x.audit.count(k) for k in "DIKR"}
    cut = sum(int(c) & repair.CUT > 0 and chr(e) != "D" for c, e in zip(codes[:, 0], x.letter, strict=True))
    assert x.cost == 3 * letters["D"] + 2 * letters["I"] + 2 * letters["R"] + cut
    assert letters["D"] + letters["K"] + letters["R"] == 20000
