"""Porter stemming (with the author's later revisions bli -> ble and logi -> log), over bytes.

Only distinct words are stemmed: a column of word arrays is dictionary-encoded by Arrow,
the dictionary is stemmed, and the ids are mapped back. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c or v for each byte; y is a vowel after a consonant."""
    out = []
    for c in word:
        vowel = c in "aeiou" or (c == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last none of w, x, y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, endings: tuple[str, ...]) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _swap(word: str, rules: dict[str, str]) -> str:
    ending = _longest(word, tuple(rules))
    if ending is None:
        return word
    stem = word[: len(word) - len(ending)]
    return stem + rules[ending] if _measure(stem) > 0 else word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    data = word.encode()
    if len(data) <= 2:
        return word
    w = data.decode("latin-1")
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]

    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        ending = _longest(w, ("ed", "ing"))
        if ending and "v" in _shape(base := w[: len(w) - len(ending)]):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _doubled(w):
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"

    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)

    ending = _longest(w, _STEP4)
    if ending == "ion" and not w[:-3].endswith(("s", "t")):
        ending = None
    if ending and _measure(w[: len(w) - len(ending)]) > 1:
        w = w[: len(w) - len(ending)]

    whole = w
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("l") and _doubled(w) and _measure(whole) > 1:
        w = w[:-1]
    return w.encode("latin-1").decode("utf-8", "replace")


def stem_values(values: pa.Array) -> pa.Array:
    encoded = values.dictionary_encode()
    return pa.array([None if w is None else stem(w) for w in encoded.dictionary.to_pylist()], pa.string()).take(encoded.indices)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        if pa.types.is_list(column.type):
            flat = stem_values(column.flatten())
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            column = pa.ListArray.from_arrays(pa.array([0, *sizes.cumsum()], pa.int32()), flat)
        else:
            column = stem_values(column)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], batch.schema.names)


def stemmed(df: DataFrame, column: str) -> DataFrame:
    """df with the words (STRING or ARRAY<STRING>) in `column`, which comes last, stemmed."""
    df = df.select(*(c for c in df.columns if c != column), column)
    return df.mapInArrow(_batches, df.schema)
