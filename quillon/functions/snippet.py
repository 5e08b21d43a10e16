"""Highlighted extracts of a text: the window richest in query terms, escaped and tagged."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.porter import stem
from quillon.functions.text import STOPWORDS, WORD, fold_py, html_escape_py

_WORD = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), WORD))
_BREAK = re.compile(rb"[ \t\n\r.,!?]")


def analyze(text: str, stemming: bool = True, stopwords: frozenset[str] = STOPWORDS) -> list[tuple[str, int, int, int]]:
    """(term, position, start_byte, end_byte) of a text's kept words."""
    out, byte, at = [], 0, 0
    for position, m in enumerate(_WORD.finditer(text)):
        byte += len(text[at : m.start()].encode())
        size = len(m[0].encode())
        word = fold_py(m[0])
        if word not in stopwords:
            out.append((stem(word) if stemming else word, position, byte, byte + size))
        byte, at = byte + size, m.end()
    return out


def _whole(data: bytes, at: int) -> int:
    """The last start of a character at or before a byte."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def best_window(tokens: Sequence[tuple[str, int, int, int]], hit: Sequence[bool], most: int) -> tuple[int, int]:
    """(start, hits): the first of the windows of `most` bytes, each from a word on, that hold the most hits whole."""
    upto = [0]
    for h in hit:
        upto.append(upto[-1] + h)
    ends = [t[3] for t in tokens]
    scores = [max(0, upto[max(i, bisect_right(ends, t[2] + most))] - upto[i]) for i, t in enumerate(tokens)]
    return tokens[scores.index(max(scores))][2], max(scores)


def windows(text: Column, terms: Sequence[str], most: int = 160, stemming: bool = False) -> Column:
    """STRUCT<start, hits> of best_window() for the terms in each text; null for texts without words."""

    @F.arrow_udf("struct<start:int,hits:long>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = []
            for t in part.to_pylist():
                tokens = analyze(t or "", stemming)
                out.append(dict(zip(("start", "hits"), best_window(tokens, [x[0] in terms for x in tokens], most))) if tokens else None)
            yield pa.array(out, pa.struct([("start", pa.int32()), ("hits", pa.int64())]))

    return run(text)


def highlight(text: str | None, terms: Sequence[str], most: int = 160, before: str = "<em>", after: str = "</em>") -> str:
    if not text:
        return ""
    data = text.encode()
    cut = lambda a, b: html_escape_py(data[a:b].decode("utf-8", "replace"))
    prefix = _whole(data, min(len(data), most))
    if not len(terms):
        return cut(0, prefix) + ("..." if len(data) > most else "")
    tokens = analyze(text)
    if not tokens:
        return cut(0, prefix)
    wanted = {*terms, *(stem(fold_py(t)) for t in terms)}
    hit = [t[0] in wanted for t in tokens]
    begin, _ = best_window(tokens, hit, most)
    end = min(len(data), begin + most)
    if end < len(data) and (stop := _BREAK.search(data, end)) and stop.start() - begin <= most + 20:
        end = stop.start()
    end = _whole(data, end)
    out, at = ["..."] if begin else [], begin
    for (_, _, a, b), h in zip(tokens, hit, strict=True):
        if b <= begin:
            continue
        if a >= end:
            break
        out.append(cut(at, a) + (f"{before}{cut(a, b)}{after}" if h else cut(a, b)))
        at = b
    if at < end:
        out.append(cut(at, end))
    return "".join(out) + ("..." if end < len(data) else "")


def snippet(text: Column, terms: Column, most: int = 160) -> Column:
    """highlight() of each row, for the few rows that are shown."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([highlight(t, [] if w is None else list(w), most) for t, w in zip(texts, wanted, strict=True)])

    return run(text, terms)


def browser_snippet(text: Column, terms: list[str], size: int = 260, lead: int = 40) -> Column:
    """The simple engine's extract: from `lead` characters before the first term found, in order of terms."""
    lower = F.lower(text)
    places = [F.when(F.instr(lower, t) > 0, F.instr(lower, t) - 1) for t in terms]
    start = F.greatest(F.coalesce(*places, F.lit(0)) - lead, F.lit(0)) if places else F.lit(0)
    body = F.substring(text, start + 1, F.lit(size))
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        body = F.replace(body, F.lit(raw), F.lit(name))
    for t in terms:
        body = F.regexp_replace(body, f"(?i)({re.escape(t)})", "<em>$1</em>")
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.when(start > 0, "...").otherwise(""), body, F.lit("...")))
