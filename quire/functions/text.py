"""Text primitives whose semantics differ between engines, written once.

White space at the ends is stripped as a set of characters (a plain trim only strips spaces), rounding is half-even, and order
in concatenations comes from an explicit position.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space that a strip removes, as a regex class.
SPACE = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Hangul syllables, and the ranges of characters that take two columns.
HANGUL = "[가-힣]"
WIDE = "[\\uac00-\\ud7a3\\u1100-\\u11ff\\u3130-\\u318f\\u3040-\\u30ff\\u4e00-\\u9fff\\uff00-\\uffef]"
# Roman numerals that order parts.
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}


def strip(c: Column) -> Column:
    """White space of any kind removed from both ends, as a set of characters (no regex runs over the text)."""
    return F.btrim(c, F.lit(SPACES))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def ordered_concat(value: Column, by: list[Column], separator: str) -> Column:
    """Aggregate: values in order, joined; nulls are left out."""
    rows = F.array_sort(F.collect_list(F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)], value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def natural_key(path: Column) -> Column:
    """Sort key: digit runs by value (of any length), other runs in lower case. A path that starts with digits gets an empty first run."""
    runs = F.regexp_extract_all(F.lower(path), F.lit("(\\d+|\\D+)"), F.lit(1))
    runs = F.when(path.rlike("^\\d"), F.concat(F.array(F.lit("")), runs)).otherwise(runs)
    digits = lambda r: F.regexp_replace(r, "^0+(?=\\d)", "")
    key = lambda r, number: F.struct(F.when(number, F.length(digits(r))).otherwise(F.lit(-1)).alias("n"), F.when(number, digits(r)).otherwise(r).alias("s"))
    return F.transform(runs, lambda r: key(r, r.rlike("^\\d+$")))


def roman_rank(c: Column) -> Column:
    """Value of a Roman numeral up to X, else 99."""
    table = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    return F.coalesce(table[c], F.lit(99))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def demote_headings(c: Column) -> Column:
    """h1 to h4 go down one level; the deepest first, so none moves twice."""
    for level in (4, 3, 2, 1):
        c = F.regexp_replace(c, f"(</?h){level}([\\s>])", f"$1{level + 1}$2")
    return c


def promote_headings(c: Column) -> Column:
    """h3 to h5 go up one level."""
    for level in (3, 4, 5):
        c = F.regexp_replace(c, f"(</?h){level}([\\s>])", f"$1{level - 1}$2")
    return c


def first_h1(html: Column) -> Column:
    """Text of the first h1, null without one."""
    found = F.regexp_extract(html, "(?s)<h1[^>]*>(.*?)</h1>", 1)
    return F.when(html.rlike("(?s)<h1[^>]*>.*?</h1>"), strip(strip_tags(found)))


def raw_h1(markdown: Column) -> Column:
    """First `# title` line, fences not respected; null without one."""
    found = F.regexp_extract(markdown, "(?md)^#\\s+(.+)$", 1)
    return F.when(markdown.rlike("(?md)^#\\s+.+$"), strip(found))


def word_count(c: Column) -> Column:
    """Words between white space of any kind. A split is one pass; regexp_extract_all copies the text for each match."""
    bare = strip(F.coalesce(c, F.lit("")))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"{SPACE}+")))


def visual_width(c: Column) -> Column:
    """Columns that a text takes: wide characters count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, f"[^{WIDE[1:-1]}]", ""))


def wrap_tables(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "(<table\\b)", '<div class="table-wrap">$1'), "(</table>)", "$1</div>")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no such function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def romanized(s: pd.Series) -> pd.Series:
    """Each character's ASCII part after compatibility decomposition, or the character where nothing is left."""

    def one(text):
        return None if text is None else "".join(unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() or c for c in text)

    return s.map(one)


def slug(text: Column) -> Column:
    """Identifier of a heading: runs of hyphens stay, empty becomes `section`."""
    kept = F.regexp_replace(romanized(text), "(?U)[^\\w\\s-]", "")
    made = F.regexp_replace(F.lower(strip(kept)), "(?U)[\\s_]+", "-")
    return F.when(made == "", F.lit("section")).otherwise(made)
