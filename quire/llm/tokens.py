"""Exact token counts by a compiled finite-state tokenizer.

A byte-level BPE file is compiled to two machines. The outer one splits text at places where no pretoken can run on: before
white space that follows something else. A chunk of text from any place to any other is then a state map that doesn't need to
know what came before: its head up to the first such place, the number of tokens between the first and the last, and its tail.
Maps compose (head of one joins the tail of the other), so the chunks of a text are reduced pairwise, as in a parallel prefix
scan. The inner machine reads a pretoken byte by byte. Its state is the chain of last tokens of the prefixes read so far; a
transition emits the change in the number of tokens. It is deterministic, since a prefix has just one encoding: its last token
is the one that is compatible with the encoding of what precedes it. Whole paths from the start to the end of a pretoken are
remembered with their total.
"""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, prepare

CHUNK_CHARS = 65_536
LIMIT = 512
#: Remembered pretokens of a worker; beyond, it starts anew (bounded memory, same results).
MOST_REMEMBERED = 600_000

# The pretoken pattern of this kind of tokenizer, over the classes of Unicode.
_PRETOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# Characters whose class is the same in every version of Unicode at hand; the class of others is asked of the library.
_UNSURE = regex.compile("[^\x00-ɏΑ-ΡΣ-ώЀ-ҁ‐-‧‰-⁞ぁ-ゖ一-龥가-힣]")
_SYNC = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")
_STAND_IN = {"letter": "a", "number": "1", "other": "-", "space": "\t"}


def byte_alphabet() -> dict[str, int]:
    """Character of a vocabulary file to byte: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """Pretokens of a text as the library would split it."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.specials = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.classes: dict[str, str] = {}

    def stand_in(self, match) -> str:
        ch = match.group()
        if ch not in self.classes:
            split = self.library.pre_tokenizer.pre_tokenize_str
            kind = "letter" if len(split("a" + ch)) == 1 else "number" if len(split("1" + ch)) == 1 else "other" if len(split("-" + ch)) == 1 else "space"
            self.classes[ch] = _STAND_IN[kind]
        return self.classes[ch]

    def pretokens(self, text: str) -> list[str]:
        """Of a text without special strings."""
        if not _UNSURE.search(text):
            return _PRETOKEN.findall(text)
        return [text[slice(*m.span())] for m in _PRETOKEN.finditer(_UNSURE.sub(self.stand_in, text))]

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """The texts between special strings, and those strings."""
        if self.special is None or not any(s in text for s in self.specials):
            return [text], []
        return self.special.split(text), self.special.findall(text)


class _Totals(dict):
    """Totals of pretokens, computed when first asked for; long pretokens aren't kept."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, pretoken: str) -> int:
        n = self.compute(pretoken)
        if len(pretoken) < 64:
            if len(self) > MOST_REMEMBERED:
                self.clear()
            self[pretoken] = n
        return n


class CountingTransducer(Splitter):
    """Number of tokens of a text."""

    def __init__(self, spec: str) -> None:
        super().__init__(spec)
        model, to_byte = json.loads(spec)["model"], byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        pairs = [[raw(t) for t in (m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        # tokens numbered by the step that makes them: single bytes first, then in the order of the merges
        self.number = {bytes([b]): b for b in range(256)}
        self.parts_of = [(b, b) for b in range(256)]
        self.merge: dict[tuple[int, int], int] = {}
        for left, right in pairs:
            made = self.number.setdefault(left + right, len(self.parts_of))
            pair = self.number[left], self.number[right]
            if made == len(self.parts_of):
                self.parts_of.append(pair)
            self.merge.setdefault(pair, made)
        missing = {raw(t) for t in model["vocab"] if t not in self.specials} ^ set(self.number)
        if missing:
            raise ValueError(f"{len(missing)} tokens of the vocabulary don't come from its merges")
        self.longest = max(map(len, self.number))
        self.fits: dict[tuple[int, int], bool] = {}
        self.totals = _Totals(self.total)

    def compatible(self, left: int, right: int) -> bool:
        """Whether one token may follow the other: no merge across their border comes before the merges that made them.

        The merges of both are undone from the latest on. Whatever then meets at the border must not merge earlier than what was
        just undone; if nothing is left to undo, the border holds.
        """
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        merge, parts, latest = self.merge, self.parts_of, len(self.parts_of) + 1
        while merge.get((left, right), latest) >= latest:
            # of equal steps the left one is done first, so the right one is undone first
            if (left > right or right < 256) and left >= 256:
                latest, left = left, parts[left][1]
            elif right >= 256:
                latest, right = right + 1, parts[right][0]
            else:
                return True
        return False

    def emissions(self, pretoken: bytes) -> list[int]:
        """What each transition along a pretoken emits: the change in the number of tokens."""
        last, count, number = [-1], [0], self.number
        for end in range(1, len(pretoken) + 1):
            for start in range(max(0, end - self.longest), end):
                token = number.get(pretoken[start:end])
                if token is not None and (not start or self.compatible(last[start], token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("the vocabulary doesn't hold every byte")
        return [b - a for a, b in zip(count, count[1:])]

    def total(self, pretoken: str) -> int:
        return sum(self.emissions(pretoken.encode()))

    def between(self, text: str) -> int:
        """Tokens of a text that starts and ends where pretokens do."""
        if not text:
            return 0
        parts, specials = self.parts(text)
        n = len(specials)
        for p in parts:
            n += sum(map(self.totals.__getitem__, self.pretokens(p)))
        return n

    def state_map(self, chunk: str) -> tuple:
        """(head, tokens between, tail) of a chunk, or (chunk,) if no pretoken is sure to end in it."""
        first = _SYNC.search(chunk)
        if not first:
            return (chunk,)
        last = first.start()
        for m in _SYNC.finditer(chunk[-4096:]):
            last = max(last, len(chunk) - len(chunk[-4096:]) + m.start())
        return chunk[: first.start()], self.between(chunk[first.start() : last]), chunk[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if len(a) == 1 or len(b) == 1:
            if len(a) == len(b) == 1:
                return self.state_map(a[0] + b[0]) if _SYNC.search(a[0][-1:] + b[0][:1]) else (a[0] + b[0],)
            if len(a) == 1:
                return self._open(a[0], b)
            return self._shut(a, b[0])
        middle = self._cut(a[2], b[0])
        return a[0], a[1] + middle + b[1], b[2]

    def _cut(self, tail: str, head: str) -> int:
        return self.between(tail + head)

    def _open(self, left: str, b: tuple) -> tuple:
        if _SYNC.search(left[-1:] + b[0][:1]):
            return left, self.between(b[0]) + b[1], b[2]
        return left + b[0], b[1], b[2]

    def _shut(self, a: tuple, right: str) -> tuple:
        if _SYNC.search(a[2][-1:] + right[:1]):
            return a[0], a[1] + self.between(a[2]), right
        return a[0], a[1], a[2] + right

    def count(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        """Tokens of a text, however it is cut into chunks."""
        if len(text) <= chunk:
            return self.between(text)
        maps = [self.state_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [reduce(self.compose, maps[i : i + 2]) for i in range(0, len(maps), 2)]
        whole = maps[0]
        return self.between(whole[0]) if len(whole) == 1 else self.between(whole[0]) + whole[1] + self.between(whole[2])


_compiled: dict[tuple[type, int], Splitter] = {}


def compiled(kind: type, spec: str):
    """One compiled tokenizer for all tasks of a worker."""
    key = (kind, hash(spec))
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = kind(spec)
    return _compiled[key]


def specification(path: str) -> str:
    """A tokenizer file, read where the query is planned; it goes to the executors with a broadcast of its 1.5 MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; a null text counts as empty, with no token.

    Repeated rows and null ids stay as they are; an empty table gives no rows; other columns are not read. Texts of any length
    are read whole, in chunks.
    """
    spark = docs.sparkSession
    prepare(spark)
    spec = spark.sparkContext.broadcast(specification(path))

    def rows(b: dict) -> dict:
        machine = compiled(CountingTransducer, spec.value)
        texts = [t or "" for t in b["text"].to_pylist()]
        counts = [machine.count(t) for t in texts]
        return {"doc_id": b["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(arrow_rows(rows, schema), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
