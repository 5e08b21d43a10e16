"""Quality rules of repetition: shares of a text's characters inside repeated n-grams and lines.

Rolling hashes of word runs are taken for many texts at once in numpy; a run's hash is
mixed with its text's number, so that one sort of 64-bit values finds the repeats of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textnp as X

#: Most of a kept text's word characters that may lie in repeated lines, in the one repeated n-gram that covers most, in any repeated n-gram.
RULES = {"line": 0.30, "top_2": 0.20, "top_3": 0.18, "top_4": 0.16, "in_5": 0.15, "in_6": 0.14, "in_7": 0.13, "in_8": 0.12, "in_9": 0.11, "in_10": 0.10}


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, and the first place and size of each run of equals in that order."""
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
    return order, start, np.diff(np.append(start, len(key)))


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The share named by each rule, for each text; 0 where a text has no words."""
    n = len(offsets) - 1
    w = X.words(data, offsets)
    size = X.characters(data, w.start, w.end)
    upto = np.append(0, np.cumsum(size))
    total = np.maximum(upto[w.first[1:]] - upto[w.first[:-1]], 1)
    out = {rule: np.zeros(n) for rule in RULES}
    m = len(w.start)
    if not m:
        return out
    salt = X.mix(w.doc.astype(np.uint64), 3)

    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, w.start) + w.doc
    head = np.flatnonzero(np.diff(line, prepend=-1))
    end = np.append(head[1:], m)
    hashed = np.append(np.uint64(0), np.cumsum(w.hash * X._power(X._BASE, m), dtype=np.uint64))
    key = X.mix((hashed[end] - hashed[head]) * X._power(X._INVERSE, m)[head] + (end - head).astype(np.uint64), 9) ^ salt[head]
    order, start, count = _repeats(key)
    again = np.repeat(count > 1, count)
    lines = order[again]
    out["line"] = np.bincount(w.doc[head[lines]], upto[end[lines]] - upto[head[lines]], n) / total

    for rule in list(RULES)[1:]:
        kind, k = rule.split("_")
        k = int(k)
        own = np.flatnonzero(np.arange(m) + k <= w.first[w.doc + 1])
        if not len(own):
            continue
        order, start, count = _repeats(X.grams(w.hash, k)[own] ^ salt[own])
        if kind == "top":
            at = own[order]
            begin = at.copy()
            begin[1:] = np.where(np.repeat(np.arange(len(start)), count)[1:] == np.repeat(np.arange(len(start)), count)[:-1], np.maximum(at[1:], at[:-1] + k), at[1:])
            covered = np.add.reduceat(upto[at + k] - upto[begin], start)[count > 1]
            doc = w.doc[at[start[count > 1]]]
            np.maximum.at(out[rule], doc, covered / total[doc])
        else:
            begins = np.zeros(m + 1, np.int64)
            begins[own[order[np.repeat(count > 1, count)]] + 1] = 1
            begun = np.cumsum(begins)
            covered = begun[1:] > begun[np.maximum(np.arange(m) - k + 1, 0)]
            out[rule] = np.bincount(w.doc[covered], size[covered], n) / total
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.string_buffer(batch.column(1))
        for i, j in X.slices(offsets, 1 << 19):
            found = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            keep = np.all([found[rule] <= most for rule, most in RULES.items()], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(np.round(v, 6)) for v in found.values()), pa.array(keep)], ["doc_id", *found, "keep"])


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a share for each rule, keep) for each row.

    Words are parted by ASCII white space; characters are those of words. line: inside lines
    whose words occur in another line of the text; in_n: inside n-grams that occur more
    than once; top_n: inside the one repeated n-gram that covers most. keep: no rule is broken. Null and
    empty texts have shares of 0 and are kept; a text of any length is measured whole, in memory of some
    fifteen times its size; null ids stay, rows that repeat are measured each, other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_batches, "doc_id long, " + ", ".join(f"{r} double" for r in RULES) + ", keep boolean")
