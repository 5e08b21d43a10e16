"""Substring dedup by paragraphs: MinHash banding, exact verification, components.

A text's lines are joined to blocks, which end at a blank line or where a line ends with
punctuation, so that wrapped passages are whole. A block is cut into paragraphs by its
content: before each word whose bigram hash is the least within REACH words on both sides. A passage that
stands inside another block is cut alike there, but for its ends: of passages of 51 words
93 % share a paragraph, of 60 or more over 98 %. Equal word sequences are one point.

BANDS bands of ROWS minima over word-pair hashes meet with probability
1 - (1 - s**ROWS)**BANDS: 0.89 at the threshold s = 0.7, 0.985 at 0.8, 1.0 at 0.9. Paragraphs that
share a band are compared by the exact Jaccard similarity of their sets of word pairs;
similar ones are joined to clusters, of which the first occurrence stays. Bands of many
paragraphs are split by their rarest word pairs first: similar sets share one of those, so no
pair is lost and unlike paragraphs don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import textnp as X
from quillon.llm.components import connected_components
from quillon.session import materialize

#: Least words of a paragraph; words on each side of a cut among which its bigram has the least hash.
MIN_WORDS, REACH = 5, 9
BANDS, ROWS = 8, 4
LEAST_JACCARD = 0.7
#: Distinct paragraphs of one band up to which all pairs are compared by join; larger groups are compared where they lie.
_SMALL = 48
_END = np.zeros(256, bool)
_END[list(b".!?:;\"')")] = True
_rng = np.random.Generator(np.random.PCG64(5))
_MULTIPLY = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def cuts(word_hash: np.ndarray, hard: np.ndarray, reach: int = REACH, least: int = MIN_WORDS) -> np.ndarray:
    """Whether a paragraph begins at each word; hard: whether a block does. No cut is within `least` words of a block's ends."""
    n = len(word_hash)
    if not n:
        return hard
    block = np.cumsum(hard) - 1
    head = np.flatnonzero(hard)
    tail = np.append(head[1:], n)
    g = np.full(n, ~np.uint64(0))
    g[:-1] = X.mix(word_hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + word_hash[1:], 3)
    g[tail - 1] = ~np.uint64(0)
    at = np.arange(n) + (block + 1) * reach  # blocks lie apart, so that windows don't reach into others
    wide = np.full(n + (len(head) + 1) * reach, ~np.uint64(0))
    wide[at] = g
    low, size = wide, 1
    while size * 2 <= reach:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[: len(low) + size - reach], low[reach - size :])  # low[k]: the least of wide[k : k + reach]
    found = (g < low[at - reach]) & (g <= low[at + 1])
    k = np.arange(n)
    return hard | found & (k - head[block] >= least) & (tail[block] - k >= least)


class Pieces:
    """The paragraphs of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS) -> None:
        w = X.words(X.fold(data), offsets, X.NON_WORD)
        line = np.searchsorted(np.flatnonzero(data == 10), w.start)
        lines = np.diff(line, prepend=0)  # line ends before each word since the word before it
        hard = np.diff(w.doc, prepend=-1) > 0
        hard[1:] |= (lines[1:] > 1) | (lines[1:] > 0) & _END[data[w.end[:-1]]]
        head = np.flatnonzero(cuts(w.hash, hard, least=min_words))
        size = np.diff(np.append(head, len(w.hash)))
        number = np.arange(len(head)) - np.searchsorted(head, w.first[w.doc[head]])
        long = size >= min_words
        head, size, self.number = head[long], size[long], number[long]
        self.words, self.first, self.size = w, head, size
        self.doc = w.doc[head]
        self.text_start = offsets[self.doc]
        self.start, self.end = w.start[head], w.end[head + size - 1]
        total = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(w.hash * X._power(X._BASE, len(w.hash)), dtype=np.uint64, out=total[1:])
        inverse = X._power(X._INVERSE, len(total))
        self.id = X.mix((total[head + size] - total[head]) * inverse[head], 77) ^ size.astype(np.uint64)

    def pairs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the chosen paragraphs' word pairs, one paragraph after another, and where each begins."""
        size = self.size[which] - 1
        first = np.cumsum(size) - size
        at = np.repeat(self.first[which] - first, size) + np.arange(size.sum())
        h = self.words.hash
        return X.mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1], 5), first


def _each_slice(batch: pa.RecordBatch, min_words: int) -> Iterator[tuple[int, int, np.ndarray, Pieces]]:
    data, offsets = X.string_buffer(batch.column(1))
    for i, j in X.slices(offsets):
        own = data[offsets[i] : offsets[j]]
        yield i, j, own, Pieces(own, offsets[i : j + 1] - offsets[i], min_words)


def _places(min_words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, lines in _each_slice(batch, min_words):
                start = X.characters(data, lines.text_start, lines.start)
                end = start + X.characters(data, lines.start, lines.end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i + lines.doc]), pa.array(lines.number.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(lines.id.view(np.int64))],
                    ["doc_id", "paragraph", "start", "end", "pid"],
                )

    return run


def signatures(lines: Pieces, which: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) band keys."""
    h, first = lines.pairs(which)
    out = np.zeros((len(which), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(which), b + 1, np.uint64)
        for k in range(b * ROWS, b * ROWS + ROWS):
            key = X.mix(key ^ np.minimum.reduceat(h * _MULTIPLY[k] + _ADD[k], first), b)
        out[:, b] = key >> np.uint64(16)  # 48 bits: the few keys that collide are told apart by their sets
    return out


def _distinct(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[tuple[Pieces, np.ndarray, np.ndarray]]:
    """The paragraphs of each slice that are new to the task, so that a task sends a passage of any number of copies once."""
    seen = np.zeros(0, np.uint64)
    for batch in batches:
        for _, _, _, lines in _each_slice(batch, min_words):
            ids, which = np.unique(lines.id, return_index=True)
            new = ~np.isin(ids, seen, assume_unique=True)
            if new.any():
                seen = np.concatenate([seen, ids[new]])
                yield lines, ids[new], which[new]


def _bands(min_words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, ids, which in _distinct(batches, min_words):
            keys = signatures(lines, which)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids.view(np.int64), BANDS))], ["key", "pid"])

    return run


def _sets(min_words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, ids, which in _distinct(batches, min_words):
            h, first = lines.pairs(which)
            row = np.repeat(np.arange(len(which), dtype=np.uint64), np.diff(np.append(first, len(h))))
            each = np.unique(row << np.uint64(32) | h >> np.uint64(32))
            size = np.bincount((each >> np.uint64(32)).astype(np.int64), minlength=len(which))
            flat = each.astype(np.uint32).tobytes()
            end = np.cumsum(size) * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array([flat[e - 4 * s : e] for e, s in zip(end, size, strict=True)], pa.binary())], ["pid", "grams"])

    return run


def _candidates(small: int):  # noqa: ANN202
    """From rows sorted by key and pid: pairs (a, b) of groups of up to `small`, and (a, null, key) for members of larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def pairs(key: np.ndarray, pid: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (pid[1:] != pid[:-1])
            key, pid = key[new], pid[new]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            group = np.repeat(np.arange(len(start)), size)
            few = np.flatnonzero((size[group] > 1) & (size[group] <= small))
            g, a, b = group[few], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for shift in range(1, int(size[g].max()) if len(g) else 1):
                same = g[:-shift] == g[shift:]
                a.append(pid[few[:-shift][same]])
                b.append(pid[few[shift:][same]])
            two = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            large = np.flatnonzero(size[group] > small)
            none = pa.nulls(len(large), pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(two[:, 0]), pa.array(pid[large])]), pa.concat_arrays([pa.array(two[:, 1]), none]), pa.concat_arrays([pa.nulls(len(two), pa.int64()), pa.array(key[large])])], ["a", "b", "key"])

        for batch in batches:
            key, pid = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last or (held and held[-1][0][-1] != key[0]):
                yield pairs(*(np.concatenate(x) for x in zip(*held, (key[:last], pid[:last]), strict=True)))
                held = []
            held.append((key[last:], pid[last:]))
        if held:
            yield pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def jaccard(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Of each two sorted sets of 32-bit numbers."""
    def rows(x: list[bytes]) -> np.ndarray:
        size = np.array([len(v) // 4 for v in x], np.int64)
        return np.repeat(np.arange(len(x), dtype=np.uint64), size) << np.uint64(32) | np.frombuffer(b"".join(x), np.uint32)

    both = np.sort(np.concatenate([rows(a), rows(b)]), kind="stable")
    common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(a))
    union = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64) // 4 - common
    return common / np.maximum(union, 1)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 5000):
            part = batch.slice(i, 5000)
            yield part.filter(pa.array(jaccard(part.column(2).to_pylist(), part.column(3).to_pylist()) >= LEAST_JACCARD)).select([0, 1])


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges that span the similar paragraphs of a group."""
    grams, pid = list(rows["grams"]), rows["a"].to_numpy(np.int64)
    left, edges, queue = np.arange(len(pid)), [], []
    while len(left):
        if queue:
            x = queue.pop()
        else:
            x, left = int(left[0]), left[1:]
        near = jaccard([grams[x]] * len(left), [grams[k] for k in left]) >= LEAST_JACCARD
        edges += [(pid[x], pid[y]) for y in left[near]]
        queue += left[near].tolist()
        left = left[~near]
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _each_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.asarray(pa.compute.binary_length(batch.column(2)), np.int64) // 4
        row = pa.array(np.repeat(np.arange(batch.num_rows), size))
        flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(flat.astype(np.int64)), pa.array(np.repeat(size, size))], ["key", "a", "gram", "size"])


def _large_edges(large: DataFrame) -> DataFrame:
    """(a, b): edges that span the similar paragraphs of each large band (key, a, grams).

    In an order of word pairs, rarest in the band first, two sets of similarity s share one of the
    first size - ceil(s * size) + 1 of each. So a band is split by those of its members' that occur twice.
    """
    each = large.mapInArrow(_each_gram, "key long, a long, gram long, size long")
    often = each.groupBy("key", "gram").count()
    order = Window.partitionBy("key", "a").orderBy("count", "gram")  # a paragraph's word pairs
    need = F.col("size") - F.ceil(F.col("size") * F.lit(LEAST_JACCARD) - 1e-9) + 1
    first = each.join(often, ["key", "gram"]).withColumn("place", F.row_number().over(order)).filter((F.col("place") <= need) & (F.col("count") > 1))
    return first.select("key", "gram", "a").join(large, ["key", "a"]).groupBy("key", "gram").applyInPandas(_forest, "a long, b long").distinct()


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, small: int = _SMALL) -> DataFrame:
    """(doc_id, paragraph, start, end, kept_doc_id, kept_paragraph): every paragraph to remove and the one that stays for it.

    paragraph counts a text's paragraphs from 0; start and end are characters in the text, from the
    first word to the last. Words are lower-cased runs of letters and digits; blocks of fewer than
    min_words stay. Of each cluster the occurrence with the least (doc_id, paragraph) stays. Null or
    empty texts have no paragraphs; a text of any length is cut as a whole, in memory of some ten
    times its size; rows without id are left out; rows that share id and paragraph number count as
    one occurrence. Repeats within a document count. Other columns are ignored. An empty table gives
    no rows. Bands of up to `small` paragraphs are compared by a join of pairs, larger ones are split.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    places, _ = materialize(rows.mapInArrow(_places(min_words), "doc_id long, paragraph int, start int, end int, pid long"), "paragraphs")
    bands = rows.mapInArrow(_bands(min_words), "key long, pid long").repartition("key").sortWithinPartitions("key", "pid")
    found, _ = materialize(bands.mapInArrow(_candidates(small), "a long, b long, key long").distinct(), "candidates")
    wanted = found.select(F.explode(F.array("a", "b")).alias("pid")).filter("pid is not null").distinct()
    sets = rows.mapInArrow(_sets(min_words), "pid long, grams binary").join(wanted, "pid", "left_semi").groupBy("pid").agg(F.first("grams").alias("grams"))
    sets, _ = materialize(sets, "grams")
    two = found.filter("b is not null").select("a", "b")
    for x in "ab":
        two = two.join(sets.select(F.col("pid").alias(x), F.col("grams").alias(f"{x}_grams")), x)
    edges = two.select("a", "b", "a_grams", "b_grams").mapInArrow(_similar, "a long, b long")
    large = found.filter("b is null").join(sets, F.col("a") == F.col("pid")).select("key", "a", "grams")
    edges = edges.union(_large_edges(large))
    clusters = connected_components(edges)
    placed = places.join(clusters, F.col("pid") == F.col("node"), "left").withColumn("cluster", F.coalesce("root", "pid"))
    firsts = placed.groupBy("cluster").agg(F.min(F.struct("doc_id", "paragraph")).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    gone = placed.join(firsts, "cluster").filter(F.struct("doc_id", "paragraph") != F.col("kept"))
    return gone.select("doc_id", "paragraph", "start", "end", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.paragraph").alias("kept_paragraph"))
