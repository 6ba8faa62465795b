"""A chapter as typed blocks: one scan over its lines finds raw HTML, diagrams, quoted code and code; the rest is prose.

The blocks lie end to end, so that their sources joined are the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

# The borders of blocks that are kept verbatim, and the mark that stands for one in text to be worked on.
RAW_OPEN, RAW_CLOSE = "@@HTML_START@@", "@@HTML_END@@"
FENCE, QUOTED_FENCE, DIAGRAM = "```", "> ```", "mermaid"
MARK = "@@TBLOCK_{}@@"
_MARKS = re.compile("@@TBLOCK_(\\d+)@@")

_WORD = re.compile(r"\w*\Z")


class Block(NamedTuple):
    """kind is prose, raw, diagram, quoted or code; source is all of it, body what stands between its borders."""

    kind: str
    source: str
    lang: str = ""
    body: str = ""


class _Borders:
    """Where lines begin that can end a block, by kind."""

    def __init__(self, text: str):
        self.fence: list[int] = []
        self.quoted: list[int] = []
        at = 0
        for line in text.split("\n"):
            if line.startswith(FENCE) and not line[len(FENCE) :].strip():
                self.fence.append(at)
            elif line.startswith(QUOTED_FENCE) and not line[len(QUOTED_FENCE) :].strip(" \t"):
                self.quoted.append(at)
            at += len(line) + 1

    @staticmethod
    def after(places: list[int], at: int) -> int | None:
        i = bisect_left(places, at)
        return places[i] if i < len(places) else None


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _opened(text: str, at: int, borders: _Borders) -> tuple[int, int, Block] | None:
    """(begin, end, block) if a block opens in the line at `at` and is closed somewhere."""
    stop = _line_end(text, at)
    line = text[at:stop]
    raw = line.find(RAW_OPEN)
    if raw >= 0 and stop < len(text) and not line[raw + len(RAW_OPEN) :].strip():
        close = text.find(RAW_CLOSE, stop)
        if close >= 0:
            begin, end = at + raw, close + len(RAW_CLOSE)
            return begin, end, Block("raw", text[begin:end], body=text[stop:close].strip())
    if at and text[at - 1] != "\n" or stop == len(text):
        return None
    if line.startswith(QUOTED_FENCE) and _WORD.match(line, len(QUOTED_FENCE)):
        close = borders.after(borders.quoted, stop + 1)
        if close is not None:
            end = _line_end(text, close)
            return at, end, Block("quoted", text[at:end], line[len(QUOTED_FENCE) :], text[stop + 1 : close])
    if line.startswith(FENCE):
        lang = line[len(FENCE) :]
        close = borders.after(borders.fence, stop + 1)
        if close is not None and lang.rstrip() == DIAGRAM:
            end = _line_end(text, close)
            return at, end, Block("diagram", text[at:end], DIAGRAM, text[stop + 1 : close])
        if close is not None and _WORD.match(lang):
            # blank lines behind a code block belong to it, up to the break before the next line of text
            end = _line_end(text, close)
            while end < len(text) and not text[end + 1 : _line_end(text, end + 1)].strip():
                end = _line_end(text, end + 1)
            return at, end, Block("code", text[at:end], lang, text[stop + 1 : close])
    return None


def scan(text: str) -> list[Block]:
    borders, out, prose, at = _Borders(text), [], 0, 0
    while at < len(text):
        found = _opened(text, at, borders)
        if found is None:
            at = _line_end(text, at) + 1
            continue
        begin, end, block = found
        if begin > prose:
            out.append(Block("prose", text[prose:begin]))
        out.append(block)
        prose = at = end
        if at < len(text) and text[at] == "\n":
            at += 1
    if prose < len(text):
        out.append(Block("prose", text[prose:]))
    return out


def protect(text: str) -> tuple[str, list[str]]:
    """The text with a numbered mark for each block that isn't prose, and the sources of these blocks."""
    shown, kept = [], []
    for block in scan(text):
        if block.kind == "prose":
            shown.append(block.source)
        else:
            shown.append(MARK.format(len(kept)))
            kept.append(block.source)
    return "".join(shown), kept


def restore(text: str, kept: list[str]) -> str:
    """Marks turned back; a mark that was never given stays."""
    parts = _MARKS.split(text)
    for i in range(1, len(parts), 2):
        n = int(parts[i])
        parts[i] = kept[n] if n < len(kept) else MARK.format(parts[i])
    return "".join(parts)
