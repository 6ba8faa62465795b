"""Structure repair of conversations: a time-major tensor DP over many conversations at once.

A conversation is valid when its role initials read `(s?(ua)+)?`. Four states follow from that: nothing yet (0), after a system
turn (1), after a user turn (2), after an assistant turn (3). Keeping a turn costs 0, giving it another role 2, deleting it 3
(blank and duplicate turns must go), inserting an empty turn 2; an undeleted truncated turn adds 1. In each state only one role
can be set or inserted, so the letters of the edits fix the repaired conversation.

Conversations of one batch are laid out time-major, in buckets of similar length. One step per turn moves the costs of all
states of all conversations of a bucket from the back to the front; they are stored, and the trace walks forward over them,
taking the smallest letter that stays on a cheapest path, again for all conversations in one step.

Each turn passes a task twice, in one sorted stream: first as a code without its text, then with it. The DP runs between the
two, so a task holds some bytes a turn and never the texts of a conversation, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

#: Turns of the conversations that one batch holds, about; a longer conversation is a batch of its own.
BATCH_TURNS = 1 << 16

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The state after the one role that can be set or inserted in a state, and that role.
NEXT = np.array([2, 2, 3, 2])
SET = ("user", "user", "assistant", "user")
#: The state after keeping a turn of initial s, u, a or another; -1 where the grammar has no such step.
KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Codes of turns: the initial, plus flags. NONE fills up conversations that are shorter than their bucket.
GONE, CUT, NONE = 4, 8, 16
FAR = 1 << 30

DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_DIGESTS = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
TURNS = "conv_id long, position long, edit string, turn long, role string, text string"
_TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations (conv_id, turn, role, text) after damage by crc32 of `conv_id:turn` modulo 20.

    0 drops a row (it stays with `present` false, so that its conversation isn't forgotten), 1 empties the text, 2 removes its
    `[.!?]`, 3 repeats the row, 4 sets the role user. Nulls count as one space, in the key as in role and text.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text")).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def whole(conversations: DataFrame) -> DataFrame:
    """The rows of conversations as they are, in the form of damaged()."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.lit(True).alias("present"))


def _stream(turns: DataFrame) -> DataFrame:
    """Turns of a conversation in one partition, sorted: batch by batch, first the codes of its turns, then their texts.

    One exchange, by conversation; the windows and the last sort keep to it.
    """
    seen = Window.partitionBy("conv_id", "present", "role", "text").orderBy("turn")
    order = Window.partitionBy("conv_id").orderBy(F.col("present").desc(), F.col("turn").asc_nulls_first(), "role", "text", "time")
    mark = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    blank = mark == ""
    repeated = F.col("time") > 1
    cut = ~F.substring(mark, -1, 1).isin(".", "!", "?")
    fault = F.when(blank, 1).when(repeated, 2).when(cut, 3).otherwise(0)
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartition(parts, "conv_id").withColumn("time", F.row_number().over(seen))
    dealt = dealt.select("*", fault.alias("fault"), F.row_number().over(order).alias("position"))
    both = F.array(F.struct(F.lit(0).alias("pass"), F.lit(None).cast("string").alias("said")), F.struct(F.lit(1).alias("pass"), F.col("text").alias("said")))
    batch = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20))
    return (
        dealt.select("conv_id", "turn", "role", "present", "fault", "position", batch.alias("batch"), F.explode(both).alias("as"))
        .select("batch", "as.pass", "conv_id", "position", "turn", "role", "present", "fault", "as.said")
        .withColumn("batch", F.floor(F.col("batch") / F.lit(_width(turns, parts))))
        .sortWithinPartitions("batch", "pass", "conv_id", "position")
    )


def _width(turns: DataFrame, parts: int) -> int:
    """How many of the 2 ** 20 hash values of a conversation make a batch, so that it holds about BATCH_TURNS turns."""
    return max(1, min(1 << 20, (BATCH_TURNS * parts << 20) // max(1, turns.count())))


class Trace:
    """The cheapest edits of one conversation: per turn its state, the inserts before it and its own letter; then what is inserted at the end."""

    __slots__ = ("cost", "state", "inserts", "letter", "audit")

    def __init__(self, cost: int, state: np.ndarray, inserts: np.ndarray, letter: np.ndarray):
        self.cost, self.state, self.inserts, self.letter = cost, state, inserts, letter
        out = np.full(int(inserts.sum()) + len(letter), ord("I"), np.uint8)
        at = np.cumsum(inserts[:-1]) + np.arange(len(letter))
        out[at] = letter
        self.audit = out.tobytes().decode()


def backward(codes: np.ndarray) -> np.ndarray:
    """Costs to the end, (turns + 1, 4 states, conversations), of time-major codes (turns, conversations)."""
    n, width = codes.shape
    costs = np.empty((n + 1, 4, width), np.int32)
    costs[n] = np.array([0, 2 * INSERT, INSERT, 0])[:, None]
    for t in range(n - 1, -1, -1):
        code, after, now = codes[t], costs[t + 1], costs[t]
        must_go, none, extra = (code & GONE) > 0, (code & NONE) > 0, np.where(code & CUT, TRUNCATED, 0)
        for s in range(4):
            to = KEEP[s][code & 3]
            kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0)[None], 0)[0], FAR)
            stay = np.where(must_go, FAR, extra + np.minimum(kept, REROLE + after[NEXT[s]]))
            now[s] = np.where(none, after[s], np.minimum(stay, DELETE + after[s]))
        two = np.minimum(now[2], np.where(none, FAR, INSERT + now[3]))
        now[3] = np.minimum(now[3], np.where(none, FAR, INSERT + now[2]))
        now[2] = two
        for s in (0, 1):
            now[s] = np.minimum(now[s], np.where(none, FAR, INSERT + two))
    return costs


def traces(codes: np.ndarray, lengths: np.ndarray) -> list[Trace]:
    """The cheapest edits of each column of time-major codes, ties to the least letters (D before I before K before R)."""
    costs = backward(codes)
    n, width = codes.shape
    state = np.zeros(width, np.int64)
    every = np.arange(width)
    states, inserts, letters = np.zeros((n + 1, width), np.int8), np.zeros((n + 1, width), np.int64), np.zeros((n, width), np.uint8)
    for t in range(n + 1):
        states[t] = state
        here, last = costs[t], t == n
        code = None if last else codes[t]
        none = np.zeros(width, bool) if last else (code & NONE) > 0
        gone = np.zeros(width, bool)
        for _ in range(3):
            if not last:
                gone = ~none & (DELETE + costs[t + 1][state, every] == here[state, every])
            put = ~none & ~gone & (INSERT + here[NEXT[state], every] == here[state, every])
            if not put.any():
                break
            inserts[t] += put
            state = np.where(put, NEXT[state], state)
        if last:
            break
        to = KEEP[state, code & 3]
        kept = ~none & ~gone & ((code & GONE) == 0) & (to >= 0)
        kept &= np.where(code & CUT, TRUNCATED, 0) + costs[t + 1][np.maximum(to, 0), every] == here[state, every]
        letters[t] = np.where(gone, ord("D"), np.where(kept, ord("K"), ord("R")))
        state = np.where(none | gone, state, np.where(kept, to, NEXT[state]))
    out = []
    for c, length in enumerate(lengths.tolist()):
        own = np.append(inserts[:length, c], inserts[n, c])
        out.append(Trace(int(costs[0, 0, c]), np.append(states[:length, c], states[n, c]), own, letters[:length, c]))
    return out


class _Batch:
    """What is known of the conversations of a batch: codes and turns first, then their traces, then running texts."""

    def __init__(self, number: int):
        self.number, self.keys, self.parts, self.at, self.traces = number, [], [], {}, None

    def add(self, key, codes, faults, turns, known) -> None:
        if key not in self.at:
            self.at[key] = len(self.keys)
            self.keys.append(key)
            self.parts.append([])
        self.parts[self.at[key]].append((codes, faults, turns, known))

    def solve(self) -> None:
        joined = [[np.concatenate(x) for x in zip(*p, strict=True)] for p in self.parts]
        self.parts = joined
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(joined):
            buckets.setdefault((len(p[0]) - 1).bit_length() if len(p[0]) else -1, []).append(i)
        self.traces = [None] * len(joined)
        for members in buckets.values():
            lengths = np.array([len(joined[i][0]) for i in members])
            codes = np.full((int(lengths.max()), len(members)), NONE, np.uint8)
            for c, i in enumerate(members):
                codes[: lengths[c], c] = joined[i][0]
            for i, x in zip(members, traces(codes, lengths), strict=True):
                self.traces[i] = x

    def figures(self, i: int) -> tuple[int, int, int, int, int]:
        """gaps, blank, duplicate, truncated and illegal neighbours of a conversation."""
        codes, faults, turns, known = self.parts[i]
        held = np.unique(turns[known])
        gaps = int(held[-1]) - int(held[0]) + 1 - len(held) if len(held) else 0
        role = codes & 3
        legal = ((role[:-1] == 0) & (role[1:] == 1)) | ((role[:-1] == 1) & (role[1:] == 2)) | ((role[:-1] == 2) & (role[1:] == 1))
        return gaps, int((faults == 1).sum()), int((faults == 2).sum()), int((faults == 3).sum()), int((~legal).sum())


def _runs(keys: pa.Array) -> list[tuple[int, int]]:
    """(begin, end) of equal neighbours."""
    values, valid = keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_valid().to_numpy(zero_copy_only=False)
    edges = np.flatnonzero((values[1:] != values[:-1]) | (valid[1:] != valid[:-1])) + 1
    cuts = [0, *edges.tolist(), len(values)]
    return list(zip(cuts, cuts[1:], strict=False))


def _repaired(rows: list[tuple], x: Trace, start: int) -> Iterator[tuple[str, int | None, str, str]]:
    """(edit, turn, role, text) of what remains of turns that begin at the number start."""
    for i, (turn, role, text) in enumerate(rows, start):
        state = int(x.state[i])
        for _ in range(x.inserts[i]):
            yield "I", None, SET[state], ""
            state = int(NEXT[state])
        if x.letter[i] != ord("D"):
            yield (chr(x.letter[i]), turn, role if x.letter[i] == ord("K") else SET[state], text)


def _ending(x: Trace) -> Iterator[tuple[str, int | None, str, str]]:
    state = int(x.state[-1])
    for _ in range(x.inserts[-1]):
        yield "I", None, SET[state], ""
        state = int(NEXT[state])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Batch, int, Iterator[tuple], bool]]:
    """(batch, conversation, remaining turns in order, whether that was its last part), conversation by conversation."""
    batch, open_, done, start = None, None, False, 0
    for b in batches:
        if not b.num_rows:
            continue
        number, second = b.column("batch").to_numpy(), b.column("pass").to_numpy()
        cuts = sorted({0, b.num_rows, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(second) != 0)) + 1).tolist()})
        for begin, end in zip(cuts, cuts[1:], strict=False):
            part = b.slice(begin, end - begin)
            if batch is None or number[begin] != batch.number:
                if open_ is not None:
                    yield batch, open_, _ending(batch.traces[open_]), True
                batch, open_ = _Batch(number[begin]), None
            if second[begin] and batch.traces is None:
                batch.solve()
            keys = part.column("conv_id")
            for lo, hi in _runs(keys):
                key, run = keys[lo].as_py(), part.slice(lo, hi - lo)
                present = run.column("present").to_numpy(zero_copy_only=False)
                if not second[begin]:
                    role = [("sua".find(r[:1]) if r[:1] else -1) for r in run.column("role").to_pylist()]
                    fault = run.column("fault").to_numpy()
                    codes = np.array([3 if r < 0 else r for r in role], np.uint8) | np.where((fault == 1) | (fault == 2), GONE, 0).astype(np.uint8) | np.where(fault == 3, CUT, 0).astype(np.uint8)
                    turns = run.column("turn")
                    known = turns.is_valid().to_numpy(zero_copy_only=False)[present]
                    batch.add(key, codes[present], fault[present], turns.fill_null(0).to_numpy()[present], known)
                    continue
                i = batch.at[key]
                if i != open_:
                    if open_ is not None:
                        yield batch, open_, _ending(batch.traces[open_]), True
                    open_, start = i, 0
                own = run.filter(pa.array(present))
                rows = list(zip(own.column("turn").to_pylist(), own.column("role").to_pylist(), own.column("said").to_pylist(), strict=True))
                yield batch, i, _repaired(rows, batch.traces[i], start), False
                start += len(rows)
    if open_ is not None:
        yield batch, open_, _ending(batch.traces[open_]), True


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, digest, empty = [], hashlib.sha256(), True
    for batch, i, rows, last in _texts(batches):
        for _, _, role, text in rows:
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
        if last:
            x = batch.traces[i]
            out.append((batch.keys[i], *batch.figures(i), x.cost, x.audit, digest.hexdigest()))
            digest, empty = hashlib.sha256(), True
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r, strict=True)) for r in out], schema=_DIGESTS)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r, strict=True)) for r in out], schema=_DIGESTS)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, at = [], 0
    for batch, i, rows, last in _texts(batches):
        for edit, turn, role, text in rows:
            out.append((batch.keys[i], at, edit, turn, role, text))
            at += 1
            if len(out) >= 512:
                yield pa.RecordBatch.from_pylist([dict(zip(_TURNS.names, r, strict=True)) for r in out], schema=_TURNS)
                out = []
        at = 0 if last else at
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(_TURNS.names, r, strict=True)) for r in out], schema=_TURNS)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations, turn by turn: conv_id, position (from 0), edit (I, K or R), turn (null for inserts), role, text.

    turns has the columns of whole() or damaged(). Turns of a conversation go by turn (nulls first), then role and text. Rows
    without a conv_id are one conversation. No rows give no rows.
    """
    prepare(turns.sparkSession)
    return _stream(turns).mapInArrow(_turns, TURNS)


def audited(turns: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and letters of its cheapest repair, and the digest of the repaired text.

    Order and nulls as in repaired(). A conversation none of whose rows is present has zeros, an empty audit and the digest of
    nothing. A turn has one fault: blank, else duplicate (role and text stood in an earlier turn), else truncated. A role whose
    first character isn't s, u or a fits nowhere. Columns besides conv_id, turn, role, text and present have no effect.
    """
    prepare(turns.sparkSession)
    return _stream(turns).mapInArrow(_digests, DIGESTS)
