"""Licence scans: a paragraph classifier on word n-grams, in DataFrame functions alone.

A multinomial logistic regression over words and word pairs tells licence families and an unknown class. It is trained where the
query is planned, on statements that are made from the fixed templates below by fixed rules (some hundred rows; no corpus row is
needed). Whole statements are left out first: a model without them sets the temperature of the probabilities and tells how often
unseen statements are judged right. The weights, then fitted to all, enter the plan as one constant. A predicted family counts only if the paragraph also holds most words of one of the family's templates.

A paragraph is a line. Only lines with one of the ANCHORS can be licence statements; by this definition all others are unknown.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
THRESHOLD = 0.5
CONFIRM = 0.6
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"

# Words that a licence statement has, as parts of lower-case words.
ANCHORS = "licen[sc]|copyright|permission|public domain|creative commons|warrant|redistribut|spdx|gpl|cc[ -]by|cc0|apache-2|bsd-[23]|mpl-2"

# How licence families are named (SPDX-like identifiers).
NAMES = {
    "apache-2.0": ["apache license version 2.0", "apache license 2.0", "apache-2.0", "apache 2.0 license"],
    "mit": ["mit license", "mit open source license", "mit/expat license", "mit licence"],
    "gpl-3.0": ["gnu general public license version 3", "gnu gpl version 3", "gpl-3.0-or-later", "gpl-3.0-only", "gpl v3"],
    "gpl-2.0": ["gnu general public license version 2", "gnu gpl version 2", "gpl-2.0-or-later", "gpl-2.0-only", "gpl v2"],
    "lgpl": ["gnu lesser general public license", "gnu lgpl", "lgpl-2.1-or-later", "lgpl license", "lgpl v3"],
    "agpl-3.0": ["gnu affero general public license version 3", "gnu agpl", "agpl-3.0-only", "agpl v3"],
    "bsd": ["bsd license", "3-clause bsd license", "bsd-3-clause", "bsd-2-clause license", "2-clause bsd license"],
    "cc-by-nc": ["cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 license", "cc-by-nc-4.0", "cc by-nc"],
    "cc-by-sa": ["cc by-sa 4.0", "creative commons attribution-sharealike 4.0 license", "cc-by-sa-4.0", "cc by-sa"],
    "cc-by": ["cc by 4.0", "creative commons attribution 4.0 international license", "cc-by-4.0", "cc by"],
    "cc0": ["cc0 1.0 universal license", "cc0 public domain dedication", "cc0-1.0", "creative commons zero"],
    "mpl-2.0": ["mozilla public license version 2.0", "mpl 2.0 license", "mpl-2.0", "mozilla public license 2.0"],
}
# What a name stands in.
CARRIERS = ["{}", "licensed under the {}", "released under {}", "spdx-license-identifier {}", "available under the terms of the {}", "distributed under {}"]
# Opening words of licence texts that don't give the name first.
OPENINGS = {
    "apache-2.0": "you may not use this file except in compliance with the license you may obtain a copy at apache.org licenses license-2.0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc0": "dedicated to the public domain under creative commons zero",
}
TEMPLATES = {f: [*(c.format(n) for n in names for c in CARRIERS), *([OPENINGS[f]] if f in OPENINGS else [])] for f, names in NAMES.items()}
# Lines with an anchor word that state no licence.
OTHERS = [
    "a valid driver license is needed to rent a car", "the restaurant was licensed to serve wine", "no permission was asked before the meeting",
    "all rights reserved", "copyright 2019 the authors", "copyright holders were not asked", "this warranty is void if the seal is broken",
    "the software comes without any warranty", "please ask for permission to enter", "the license plate was hard to read", "redistribution of wealth was debated",
    "the police had no warrant", "his licence to kill was revoked", "fishing license fees went up", "the book entered the public domain in 1923",
    "creative commons is an organisation", "version 2.0 of the apache helicopter", "a student at mit wrote the paper", "the general public was invited", "license agreement",
    "terms and conditions of the license apply", "the license of the work is not known", "contact us about a commercial license", "the permission slip was signed",
    "the gpl was discussed at length", "send a copy to the author cc by mail", "released under the name of the band", "available under the counter without a licence",
    "distributed under strict copyright", "licensed under state law", "licensed to drive", "spdx-license-identifier none", "the terms of the warranty are available under request",
]
# What may stand around a statement.
WRAPPINGS = ["{}", "this work is {}", "this project is {}", "the code is {}", "{} see the file license for details", "all content is {}", "copyright 2020 the authors {}", "note {} unless stated otherwise"]


def grams(line: str) -> list[str]:
    """Distinct words and word pairs of a line."""
    t = regex.findall(TOKEN, line.lower())
    return list(dict.fromkeys([*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))]))


class Model:
    """Rounded weights by n-gram, the intercepts and the temperature."""

    def __init__(self, templates: dict[str, list[str]], others: list[str], wrappings: list[str]) -> None:
        self.families = [*sorted(templates), UNKNOWN]
        said = [(t, i) for i, f in enumerate(self.families[:-1]) for t in templates[f]] + [(t, len(templates)) for t in others]
        # whole statements are left out, never single wrappings of them: all that hold a family's last name, every third other
        last = {names[-1] for names in NAMES.values()}
        away = [any(t.endswith(n) and n in last for n in NAMES.get(self.families[i], ())) if i < len(templates) else others.index(t) % 3 == 0 for t, i in said]
        rows = [(w.format(t), i, out) for (t, i), out in zip(said, away) for w in wrappings]
        fold = np.array([out for _, _, out in rows])
        names = sorted({g for line, _, _ in rows for g in grams(line)})
        at = {g: i for i, g in enumerate(names)}
        x = np.zeros((len(rows), len(names) + 1))
        x[:, -1] = 1
        for i, (line, _, _) in enumerate(rows):
            x[i, [at[g] for g in grams(line)]] = 1
        y = np.eye(len(self.families))[[c for _, c, _ in rows]]
        w = self._fitted(x[~fold], y[~fold])
        chance = {t: self._softmax(x[fold] @ w / t) for t in self.temperatures}
        loss = {t: -np.log(np.maximum(1e-12, (p * y[fold]).sum(1))).mean() for t, p in chance.items()}
        self.temperature = min(loss, key=loss.get)
        p = chance[self.temperature]
        hit = np.argmax(p, 1) == np.argmax(y[fold], 1)
        self.right = float(hit.mean())
        #: Mean distance of stated probability and accuracy over five bins, on statements that were left out.
        bins = np.minimum((p.max(1) * 5).astype(int), 4)
        self.calibration_error = float(sum(abs(p.max(1)[bins == b].mean() - hit[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist())))
        w = np.round(self._fitted(x, y), 3)
        self.bias = w[-1].tolist()
        self.weights = {g: w[i].tolist() for g, i in at.items() if np.abs(w[i]).max() >= 0.02}

    def _fitted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Weights by gradient steps; every class counts alike."""
        weight = (1 / np.maximum(1, y.sum(0)) @ y.T)[:, None]
        weight = weight / weight.mean()
        w = np.zeros((x.shape[1], y.shape[1]))
        for _ in range(400):
            w -= 0.5 * (x.T @ (weight * (self._softmax(x @ w) - y)) / len(x) + 2e-4 * w)
        return w

    temperatures = [0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


@lru_cache(1)
def default_model() -> Model:
    return Model(TEMPLATES, OTHERS, WRAPPINGS)


def template_words(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """Distinct sets of words: a statement with a name confirms as the name alone does."""
    short = {f: [*NAMES.get(f, templates[f]), *([OPENINGS[f]] if f in OPENINGS and f in NAMES else [])] for f in templates}
    return [(f, sorted(set(regex.findall(TOKEN, t)))) for f in sorted(short) for t in short[f]]


def _judged(line: Column, model: Model, templates: dict[str, list[str]]) -> Column:
    """struct(family, p) of one line; family is unknown where it isn't sure or no template confirms it."""
    const = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)  # noqa: E731  folded to one literal
    weights = const(model.weights, "map<string,array<double>>")
    words = F.regexp_extract_all(F.lower(line), F.lit(f"({TOKEN})"), F.lit(1))
    pairs = lambda t: F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    both = lambda t: F.concat(t, F.when(F.size(t) > 1, F.slice(pairs(t), 1, F.size(t) - 1)).otherwise(F.array().cast("array<string>")))
    known = F.array_intersect(both(words), const(sorted(model.weights), "array<string>"))
    add = lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b)
    scores = F.aggregate(known, const(model.bias, "array<double>"), add)
    listed = const(model.families, "array<string>")
    held = const([{"f": f, "w": w} for f, w in template_words(templates)], "array<struct<f:string,w:array<string>>>")
    share = lambda t: F.size(F.array_intersect(t.w, words)) / F.size(t.w)

    def decided(s: Column) -> Column:
        top = F.array_max(s)
        total = F.aggregate(F.transform(s, lambda v: F.exp((v - top) / model.temperature)), F.lit(0.0), lambda a, b: a + b)
        return F.struct(F.element_at(listed, F.array_position(s, top).cast("int")).alias("family"), F.round(1 / total, 4).alias("p"))

    first = F.transform(F.array(scores), decided)[0]

    def confirmed(d: Column) -> Column:
        ok = (d.p >= THRESHOLD) & F.exists(held, lambda t: (t.f == d.family) & (share(t) >= CONFIRM))
        return F.struct(F.when(ok, d.family).otherwise(F.lit(UNKNOWN)).alias("family"), d.p.alias("p"))

    return F.transform(F.array(first), confirmed)[0]


def scan(docs: DataFrame, text: str = "text", model: Model | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, candidates, confirmed, families, best_family, best_p) for every row, without a shuffle.

    candidates: lines with an anchor word; confirmed: those of a licence family; families: the distinct families in order, joined
    by commas ('' if none); best_family and best_p: of the surest confirmed line (ties: the first family), else null. A null or
    empty text has no lines. Repeated rows and null ids stay; an empty table gives no rows; other columns are not read.
    """
    model, templates = model or default_model(), templates or TEMPLATES
    anchor = F.lit(f"(?i)(?:{ANCHORS})")
    body = F.col(text)
    lines = F.when(F.regexp_like(body, anchor), F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, anchor))).otherwise(F.array().cast("array<string>"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("_lines"))
    found = found.select("doc_id", F.transform("_lines", lambda x: _judged(x, model, templates)).alias("_all"))
    found = found.withColumn("_sure", F.filter("_all", lambda x: x.family != UNKNOWN))
    best = F.array_min(F.transform("_sure", lambda x: F.struct((-x.p).alias("p"), x.family.alias("family"))))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("_sure", lambda x: x.family))), ",")
    return found.select("doc_id", F.size("_all").alias("candidates"), F.size("_sure").alias("confirmed"), names.alias("families"), best["family"].alias("best_family"), (-best["p"]).alias("best_p"))


def oracle(model: Model | None = None) -> str:
    """The same scan as DuckDB SQL: n-grams are unnested and joined to the weights."""
    model = model or default_model()
    text = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ",".join(f"({text(g)},{c},{w})" for g, ws in model.weights.items() for c, w in enumerate(ws) if w)
    bias = ",".join(f"({c},{text(f)},{b})" for c, (f, b) in enumerate(zip(model.families, model.bias)))
    held = ",".join(f"({text(f)},{i},{text(w)},{len(ws)})" for i, (f, ws) in enumerate(template_words(TEMPLATES)) for w in ws)
    return f"""
WITH weights(g, c, w) AS (VALUES {weights}),
 bias(c, family, b) AS (VALUES {bias}),
 held(family, ix, w, n) AS (VALUES {held}),
 rows AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
 lines AS (SELECT rid, lid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS lid
   FROM rows WHERE regexp_matches(text, '(?i)({ANCHORS})')) WHERE regexp_matches(line, '(?i)({ANCHORS})')),
 toks AS (SELECT rid, lid, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (SELECT rid, lid, regexp_extract_all(lower(line), '{TOKEN}') AS t FROM lines)),
 grams AS (SELECT DISTINCT rid, lid, tok AS g FROM toks UNION
   SELECT DISTINCT a.rid, a.lid, a.tok || ' ' || b.tok FROM toks a JOIN toks b ON a.rid = b.rid AND a.lid = b.lid AND b.pos = a.pos + 1),
 summed AS (SELECT rid, lid, c, sum(w) AS s FROM grams JOIN weights USING (g) GROUP BY ALL),
 scores AS (SELECT l.rid, l.lid, b.c, b.family, b.b + coalesce(s.s, 0) AS s FROM lines l CROSS JOIN bias b LEFT JOIN summed s ON s.rid = l.rid AND s.lid = l.lid AND s.c = b.c),
 decided AS (SELECT rid, lid, arg_min(family, (-s, c)) AS family, round(1 / sum(exp((s - top) / {model.temperature})), 4) AS p
   FROM (SELECT *, max(s) OVER (PARTITION BY rid, lid) AS top FROM scores) GROUP BY rid, lid),
 shares AS (SELECT t.rid, t.lid, h.family, h.ix, count(*) * 1.0 / any_value(h.n) AS share FROM (SELECT DISTINCT rid, lid, tok FROM toks) t JOIN held h ON h.w = t.tok GROUP BY ALL),
 sure AS (SELECT d.rid, d.lid, d.family, d.p FROM decided d WHERE d.family <> '{UNKNOWN}' AND d.p >= {THRESHOLD}
   AND EXISTS (SELECT 1 FROM shares s WHERE s.rid = d.rid AND s.lid = d.lid AND s.family = d.family AND s.share >= {CONFIRM})),
 per AS (SELECT rid, count(*) AS confirmed, string_agg(DISTINCT family, ',' ORDER BY family) AS families, arg_min(family, (-p, family)) AS best_family, max(p) AS best_p FROM sure GROUP BY rid),
 cand AS (SELECT rid, count(*) AS candidates FROM lines GROUP BY rid)
SELECT doc_id, coalesce(candidates, 0)::INT AS candidates, coalesce(confirmed, 0)::INT AS confirmed, coalesce(families, '') AS families, best_family, best_p
FROM rows LEFT JOIN cand USING (rid) LEFT JOIN per USING (rid)"""
