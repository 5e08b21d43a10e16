"""SimHash near-dedup with Golay-code fuzzy hashing.

A document's 92-bit SimHash (distinct words, weight sqrt(count)) is four segments of 23
bits. Each segment is decoded to the indices of nearby Golay codewords, one or six keys,
such that segments at most 2 bits apart share one. Two fingerprints meet where a pair of
segments shares an index each: they are sent by an index of the first (or of both, for
many points) and matched by the second there. Fingerprints at most 8 bits apart have
at most two segments with 3 or more errors, so another pair of segments always meets:
up to 8 bits the search is exact. The bits are cut to segments in LAYOUTS ways, the first in
their order, the others shuffled; of random pairs 14 bits apart 99.7 % meet, 18 bits apart 93 %.

Documents of one fingerprint and one MinHash sketch are one point of the search. A bucket yields
the edges of a spanning forest of the points within MOST_BITS of each other whose word sets are
alike by their sketches, which go to the bucket with them, and not all pairs, so groups of
thousands of copies stay linear; equal fingerprints alone join nothing. A large bucket is split by
its points' rarest minima, as alike sketches agree in one of the SKETCH - LEAST_EQUAL + 1 that come first
in any order. Groups are connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textnp as X
from quillon.llm.components import connected_components
from quillon.llm.golay import BITS, MESSAGE, near_indices
from quillon.llm.names import fresh
from quillon.session import materialize

SEGMENTS, LAYOUTS = 4, 3
MOST_BITS = 18
SKETCH = 48
#: Least estimated Jaccard similarity of two near copies' word sets.
LEAST_JACCARD = 0.45
LEAST_EQUAL = 22  # the least number of equal minima for that
_PAIRS = [(SEGMENTS * r + i, SEGMENTS * r + j) for r in range(LAYOUTS) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS)]
_rng = np.random.Generator(np.random.PCG64(9))
_SHUFFLED = [_rng.permutation(SEGMENTS * BITS) for _ in range(LAYOUTS - 1)]
#: Points of a group up to which it is not split.
GROUP_POINTS = 1 << 15
#: Buckets up to _SMALL points compare all pairs at once, larger ones span a forest, above MANY by groups; the components are the same.
_SMALL, MANY = 48, 2000
#: Points of a forest that are compared with the rest at once, and near ones of each, on average, from which a component is grown.
_BLOCK, _NEAR = 64, 16
#: Pairs whose distances are held at once.
_AT_ONCE = 1 << 20


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, 4) segments, (n, SKETCH) uint16 sketches, and whether a text has words."""
    n = len(offsets) - 1
    w = X.words(X.fold(data), offsets, X.NON_WORD)
    order = np.lexsort((w.hash, w.doc))
    doc, h = w.doc[order], w.hash[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(doc)))
    doc, h = doc[at], h[at]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    has = np.zeros(n, bool)
    has[doc[first]] = True
    segments, sketch = np.zeros((n, SEGMENTS), np.int32), np.zeros((n, SKETCH), np.uint16)
    if len(doc):
        weight = np.sqrt(count).astype(np.float32)
        sums = np.empty((len(first), SEGMENTS * BITS), np.float32)
        for s in range(SEGMENTS):
            mixed = X.mix(h, 11 + s)
            for k in range(BITS):
                sign = ((mixed >> np.uint64(40 + k)) & np.uint64(1)).astype(np.float32)
                sums[:, s * BITS + k] = np.add.reduceat((2 * sign - 1) * weight, first)
        bits = (sums > 0).reshape(len(first), SEGMENTS, BITS)
        segments[doc[first]] = bits @ (1 << np.arange(BITS)).astype(np.int32)
        for k in range(SKETCH):
            sketch[doc[first], k] = (np.minimum.reduceat(X.mix(h, 101 + k), first) >> np.uint64(20)).astype(np.uint16)
    return segments, sketch, has


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, (data, offsets) = batch.column(0), X.string_buffer(batch.column(1))
        for i, j in X.slices(offsets, 1 << 19):
            seg, sketch, has = fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            seg = seg.astype(np.int64)
            own = pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(seg[:, 0] << BITS | seg[:, 1]), pa.array(seg[:, 2] << BITS | seg[:, 3]), pa.array([x.tobytes() for x in sketch], pa.binary())],
                ["doc_id", "hi", "lo", "sketch"],
            )
            yield own.filter(pa.array(has))


def _segments(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """SEGMENTS segments of each layout."""
    low = (1 << BITS) - 1
    out = [(x & low).astype(np.int32) for x in (hi >> BITS, hi, lo >> BITS, lo)]
    for order in _SHUFFLED:
        for s in range(SEGMENTS):
            own = np.zeros(len(hi), np.int32)
            for k, bit in enumerate(order[s * BITS : (s + 1) * BITS].tolist()):
                own |= ((hi >> bit if bit < 2 * BITS else lo >> bit - 2 * BITS) & 1).astype(np.int32) << k
            out.append(own)
    return out


def groups(hi: np.ndarray, lo: np.ndarray, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, group): where a fingerprint is sent to.

    A group is a segment and one of its indices; all second segments are paired with it
    there. With split bits, a group is a pair of segments, one index of the first and the
    leading bits of one of the second, so that groups stay small for any number of points.
    """
    near = [near_indices(x) for x in _segments(hi, lo)]
    rows, found = [], []
    if not split:
        for i in (k for k in range(SEGMENTS * LAYOUTS) if (k + 1) % SEGMENTS):
            row, x = np.nonzero(near[i] >= 0)
            rows.append(row)
            found.append((i << MESSAGE | near[i][row, x]).astype(np.int64))
        return np.concatenate(rows), np.concatenate(found)
    for p, (i, j) in enumerate(_PAIRS):
        row, x, y = np.nonzero((near[i] >= 0)[:, :, None] & (near[j] >= 0)[:, None, :])
        group = (p << MESSAGE | near[i][row, x]).astype(np.int64) << split | near[j][row, y] >> MESSAGE - split
        both = np.unique(np.stack([row, group]), axis=1)
        rows.append(both[0])
        found.append(both[1])
    return np.concatenate(rows), np.concatenate(found)


def _group_batches(split: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i in range(0, len(hi), 1000):
                row, group = groups(hi[i : i + 1000], lo[i : i + 1000], split)
                yield pa.RecordBatch.from_arrays([pa.array(group), *(batch.column(k).take(pa.array(i + row)) for k in range(4))], ["g", "hi", "lo", "rep", "sketch"])

    return run


def second_keys(group: np.ndarray, hi: np.ndarray, lo: np.ndarray, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): rows of a group that share an index of a second segment too have equal keys."""
    ordinal = np.cumsum(np.append(False, group[1:] != group[:-1]))
    segments, first = _segments(hi, lo), group >> MESSAGE + split
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for j in (k for k in range(SEGMENTS * LAYOUTS) if k % SEGMENTS):
        if split:
            own = np.flatnonzero(np.isin(first, [p for p, (_, y) in enumerate(_PAIRS) if y == j]))
        else:
            own = np.flatnonzero((first < j) & (first // SEGMENTS == j // SEGMENTS))
        near = near_indices(segments[j][own])
        good = near >= 0
        if split:
            good &= near >> MESSAGE - split == (group[own] & (1 << split) - 1)[:, None]
        row, x = np.nonzero(good)
        rows.append(own[row])
        keys.append((ordinal[own[row]] * (SEGMENTS * LAYOUTS) + j) << MESSAGE | near[row, x])
    return np.concatenate(rows), np.concatenate(keys)


def distance(a_hi: np.ndarray, a_lo: np.ndarray, b_hi: np.ndarray, b_lo: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a_hi ^ b_hi).astype(np.int32) + np.bitwise_count(a_lo ^ b_lo)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches (or one and others) are of word sets alike; sketches of no width always are."""
    return (a == b).sum(1) >= (LEAST_EQUAL if b.shape[1] else 0)


def forest(hi: np.ndarray, lo: np.ndarray, most: int = MOST_BITS, sketch: np.ndarray | None = None) -> np.ndarray:
    """(n, 2) edges that span the components of the points at most `most` bits apart, and alike if sketches are given.

    Up to _BLOCK points are compared with all others at once: points with few near ones are then done. Where there
    are many near ones, the component of one point is grown instead, and leaves the rest as a whole.
    """
    sketch = np.zeros((len(hi), 0), np.uint16) if sketch is None else sketch
    left, size = np.arange(len(hi)), _BLOCK
    found = [np.zeros((0, 2), np.int64)]

    def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(distance(hi[x][:, None], lo[x][:, None], hi[left], lo[left]) <= most)

    while len(left):
        size = min(size, max(1, _AT_ONCE // len(left)))
        a, b = near(left[:size])
        later = b > a
        a, b = a[later], b[later]
        if len(a) <= _NEAR * size:
            same = alike(sketch[left[a]], sketch[left[b]])
            found.append(np.stack([left[a[same]], left[b[same]]], 1))
            left, size = left[size:], min(2 * size, _BLOCK)
            continue
        k = int(np.bincount(a).argmax())
        queue, left, size = left[k : k + 1], np.delete(left, k), max(1, size // 4)
        step = 1  # the first point reaches most of its component
        while len(queue) and len(left):
            x, queue = queue[:step], queue[step:]
            a, b = near(x)
            same = alike(sketch[x[a]], sketch[left[b]])
            b, first = np.unique(b[same], return_index=True)
            found.append(np.stack([x[a[same][first]], left[b]], 1))
            queue, left = np.append(queue, left[b]), np.delete(left, b)
            step = min(2 * step, _BLOCK, max(1, _AT_ONCE // max(1, len(left))))
    return np.concatenate(found)


def split_forest(hi: np.ndarray, lo: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """As forest, for many points that may be unlike: by groups that share one of their rarest minima.

    In any order of the minima, of two sketches that agree in LEAST_EQUAL of SKETCH the first SKETCH - LEAST_EQUAL + 1
    of each have one in common; the rarest come first, so that the minima of usual words bring no points together.
    """
    first = SKETCH - LEAST_EQUAL + 1
    minimum = np.arange(SKETCH, dtype=np.int64) << 16 | sketch
    count = np.bincount(minimum.ravel(), minlength=SKETCH << 16)
    rare = np.partition(count[minimum] << 22 | minimum, first - 1, axis=1)[:, :first].ravel()
    row = np.repeat(np.arange(len(hi)), first)[rare >> 22 > 1]
    rare = rare[rare >> 22 > 1]
    order = np.argsort(rare, kind="stable")
    row, rare = row[order], rare[order]
    return row[bucket_edges(rare, hi[row], lo[row], sketch, row, split=False)]


def _sketches(batch: pa.RecordBatch) -> np.ndarray:
    """(n, SKETCH) of the fifth column; of no width without one."""
    if batch.num_columns < 5:
        return np.zeros((batch.num_rows, 0), np.uint16)
    column = batch.column(4).cast(pa.large_binary())
    first = np.frombuffer(column.buffers()[1], np.int64)[column.offset] // 2
    return np.frombuffer(column.buffers()[2], np.uint16)[first : first + len(column) * SKETCH].reshape(-1, SKETCH)


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole groups of equal keys from batches sorted by key, many at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = (*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)), _sketches(batch))
        last = int(np.searchsorted(now[0], now[0][-1]))
        if last or (held and held[-1][0][-1] != now[0][0]):
            yield tuple(np.concatenate(x) for x in zip(*held, tuple(c[:last] for c in now), strict=True))
            held = []
        held.append(tuple(c[last:] for c in now))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def bucket_edges(key: np.ndarray, hi: np.ndarray, lo: np.ndarray, sketch: np.ndarray, row: np.ndarray, most: int = _SMALL, split: bool = True) -> np.ndarray:
    """(n, 2) places within MOST_BITS and alike that span the groups of each run of equal keys; row has each place's sketch."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    group = np.repeat(np.arange(len(start)), size)
    small = np.flatnonzero((size[group] > 1) & (size[group] <= most))
    g = group[small]
    for shift in range(1, int(size[g].max()) if len(g) else 1):
        same = g[:-shift] == g[shift:]
        a, b = small[:-shift][same], small[shift:][same]
        near = distance(hi[a], lo[a], hi[b], lo[b]) <= MOST_BITS
        a, b = a[near], b[near]
        near = alike(sketch[row[a]], sketch[row[b]])
        found.append(np.stack([a[near], b[near]], 1))
    for k in np.flatnonzero(size > most):
        own = slice(start[k], start[k] + size[k])
        span = split_forest if split and size[k] > MANY and sketch.shape[1] else forest
        found.append(span(hi[own], lo[own], sketch=sketch[row[own]]) + start[k])
    return np.concatenate(found)


def _edge_batches(split: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, hi, lo, rep, sketch in _sorted_groups(batches):
            row, key = second_keys(group, hi, lo, split)
            order = np.argsort(key)
            row = row[order]
            e = rep[row[bucket_edges(key[order], hi[row], lo[row], sketch, row)]]
            if len(e):
                e = np.unique(np.sort(e, axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return run


def near_pairs(points: DataFrame) -> DataFrame:
    """Edges (a, b) among points (hi, lo, rep, sketch), named by rep, that span each bucket's groups."""
    split = max(0, (points.count() // GROUP_POINTS).bit_length() - 11)  # a group has 1 / 773 of the points, or 1 / (773 * 2**split) in pairs
    sent = points.select("hi", "lo", "rep", "sketch").mapInArrow(_group_batches(min(split, MESSAGE)), "g long, hi long, lo long, rep long, sketch binary")
    return sent.repartition("g").sortWithinPartitions("g").mapInArrow(_edge_batches(min(split, MESSAGE)), "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, keep) for each row with an id: group_id is the least id of its group of near copies.

    Groups are the components of pairs of documents whose fingerprints differ in at most
    MOST_BITS of 92 bits and whose word sets are alike. Words are lower-cased runs of
    letters and digits. A document without words (null or empty text) is alone. A text of any length
    is read whole, in memory of some ten times its size. Rows without
    id are left out. Rows that share an id share the fate of that id: if any of them is in a
    group, all are, and keep says whether the id is the group's least. Other columns are ignored. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    prints, _ = materialize(rows.mapInArrow(_fingerprint_batches, "doc_id long, hi long, lo long, sketch binary").withColumn("s", F.xxhash64("sketch")), "fingerprints")
    same = ["hi", "lo", "s"]
    points, _ = materialize(prints.groupBy(*same).agg(F.min(F.struct("doc_id", "sketch")).alias("p")).select(*same, F.col("p.doc_id").alias("rep"), F.col("p.sketch").alias("sketch")), "points")
    placed = prints.select("doc_id", *same).join(points.select(*same, "rep"), same).select("doc_id", "rep").distinct()
    placed, _ = materialize(placed, "placed")
    each = placed.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    several = placed.join(each.filter("rep <> other").select("doc_id", F.col("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")
    clusters = connected_components(near_pairs(points).union(several))
    each = each.join(clusters, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    group = F.coalesce("root", "doc_id")
    return rows.select("doc_id").join(each, "doc_id", "left").select("doc_id", group.alias("group_id"), (group == F.col("doc_id")).alias("keep"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are near copies of one with a lower id; rows without id stay."""
    (own,) = fresh(docs, "near_id")
    gone = near_groups(docs, id_col, text_col).filter("not keep").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(own), "left_anti")
