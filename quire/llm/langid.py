"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte n-grams of the whole lower-cased text (square roots of frequencies, scaled to length one). Both steps
are linear support vector machines with squared hinge loss, trained here by Newton steps on a bounded sample of labelled rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, prepare

#: Hash buckets for byte trigrams, besides 256 for single bytes.
BUCKETS = 4096
#: Labelled rows of a language that are used for training, on average (chosen by hash).
TRAINING_ROWS = 300
PENALTY = 1e-3
UNDETERMINED = "und"

# Language families by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt tk",
    "indic": "hi bn mr ur pa gu ne si",
    "semitic": "ar he mt am",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"={lang}")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the features of a text that has letters."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    t = b.astype(np.uint32)
    grams = ((t[:-2] << 16 | t[1:-1] << 8 | t[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.concatenate([np.bincount(b, minlength=256) / len(b), np.bincount(grams, minlength=BUCKETS) / len(grams)])
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at])
    return at, values / np.linalg.norm(values)


def svm(k: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Coefficients of the rows of a Gram matrix for a squared-hinge SVM (Newton steps in the span of the rows)."""
    beta, active = np.zeros(len(y)), np.ones(len(y), bool)
    for _ in range(30):
        beta = np.zeros(len(y))
        sub = k[np.ix_(active, active)]
        beta[active] = np.linalg.solve(sub + penalty * len(y) * np.eye(len(sub)), y[active])
        now = y * (k @ beta) < 1
        if (now == active).all() or not now.any():
            break
        active = now
    return beta


class Model:
    """Weight vectors: one per family against the others, and one per pair of languages of a family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray) -> None:
        self.langs = sorted(set(langs.tolist()))
        self.families = sorted({family(x) for x in self.langs})
        gram = x @ x.T + 1.0  # the constant is the intercept
        of = np.array([family(v) for v in langs])
        vectors: list[np.ndarray] = []

        def fit(rows: np.ndarray, yes: np.ndarray) -> None:
            beta = svm(gram[np.ix_(rows, rows)], np.where(yes, 1.0, -1.0))
            vectors.append(np.append(x[rows].T @ beta, beta.sum()))

        every = np.arange(len(langs))
        self.split = len(self.families) > 1
        if self.split:
            for f in self.families:
                fit(every, of == f)
        self.pairs = {f: list(combinations([v for v in self.langs if family(v) == f], 2)) for f in self.families}
        self.first = {}
        for f, pairs in self.pairs.items():
            self.first[f] = len(vectors)
            for a, b in pairs:
                rows = np.flatnonzero((langs == a) | (langs == b))
                fit(rows, langs[rows] == a)
        self.weights = np.array(vectors).reshape(len(vectors), x.shape[1] + 1).T.astype(np.float64)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        at, values = features(text)
        margins = values @ self.weights[at] + self.weights[-1]
        sure = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -50, 50)))
        f, score = self.families[0], 1.0
        if self.split:
            m = margins[: len(self.families)]
            f, score = self.families[int(np.argmax(m))], float(sure(m.max()))
        votes = {v: [0, 0.0, 1.0] for v in self.langs if family(v) == f}
        for i, (a, b) in enumerate(self.pairs[f]):
            m = float(margins[self.first[f] + i])
            votes[a if m > 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
            votes[a][2] = min(votes[a][2], sure(m))
            votes[b][2] = min(votes[b][2], sure(-m))
        best = max(sorted(votes), key=lambda v: votes[v][:2])
        return best, float(score * votes[best][2])


def held_out(doc_id) -> F.Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 on division by 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """From the text and lang of labelled rows that aren't held out; about `rows` of each language, chosen by hash.

    What reaches the driver is bounded: some thousand feature values a row, and `rows` rows a language on average.
    """
    prepare(docs.sparkSession)
    usable = docs.filter(~held_out(F.col("doc_id"))).filter("doc_id is not null and lang is not null and text is not null")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, rows / n) * (1 << 30)))).otherwise(share)
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share).select("doc_id", "lang", "text")

    def found(b: dict) -> dict:
        made = [features(t) if _LETTER.search(t) else None for t in b["text"].to_pylist()]
        return {
            "doc_id": b["doc_id"], "lang": b["lang"],
            "at": [None if m is None else m[0].astype("<u2").tobytes() for m in made],
            "value": [None if m is None else m[1].astype("<f4").tobytes() for m in made],
        }

    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("value", pa.binary())])
    got = chosen.mapInArrow(arrow_rows(found, schema), "doc_id long, lang string, at binary, value binary").filter("at is not null").collect()
    got.sort(key=lambda r: (r.doc_id, r.lang, r.at))
    x = np.zeros((len(got), 256 + BUCKETS))
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.at, "<u2")] = np.frombuffer(r.value, "<f4")
    return Model(x, np.array([r.lang for r in got], dtype=object))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, from its whole text.

    A text that is null or has no letters, or any text where nothing could be learned, gets `und` with score 0. Repeated rows
    and null ids stay; an empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    if not isinstance(model, Model):
        model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(b: dict) -> dict:
        made = [shared.value.predict(t) for t in b["text"].to_pylist()]
        return {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    read = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return read.mapInArrow(arrow_rows(rows, schema), "doc_id long, held_out boolean, lang_pred string, score double")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of a documents table whose language can be told; all columns as they were."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            keep = [shared.value.predict(t)[0] != UNDETERMINED for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
