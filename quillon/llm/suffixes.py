"""Suffix-array dedup: repeated runs of at least LENGTH words, anywhere in the corpus.

Two runs of LENGTH words are equal only if their anchors are, an anchor being the least
hash of GRAM words inside the run. So the suffixes to sort are those at anchors that
occur more than once: about one in (LENGTH - GRAM + 2) / 2 words, and of these the repeated.
Each is shipped with the words that the runs owning the anchor reach to its left and right.
Spark's range partitioning samples splitters among the suffixes' heads, their leading GRAM
words. Equal heads never straddle a boundary, so no pair of equal runs does, and there is nothing
to compare across boundaries. A task numbers the words of some whole heads at a time by a dictionary of
their bytes, sorts the suffixes by multikey quicksort, and the words to their left likewise; a run is repeated if the classes on
both sides are shared, as read from the two arrays of common prefix lengths. Words are compared by
number, that is by their bytes: the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import textnp as X
from quillon.session import materialize

LENGTH, GRAM = 50, 16
#: Bytes of words that a task sorts at a time, in whole heads.
CHUNK_BYTES = 4 << 20


def anchors(word_hash: np.ndarray, first: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(doc, start, end, anchor, hash): runs start..end of texts (word numbers) share an anchor; first as in Words."""
    none = np.zeros(0, np.int64)
    if len(word_hash) < length:
        return none, none, none, none, none.view(np.uint64)
    g = X.grams(word_hash, gram)
    at, size, span = np.arange(len(g)), 1, length - gram + 1
    while size * 2 <= span:
        a, b = at[:-size], at[size:]
        at, size = np.where(g[a] <= g[b], a, b), size * 2
    if span > size:
        a, b = at[: size - span], at[span - size :]
        at = np.where(g[a] <= g[b], a, b)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(at)]
    run = np.flatnonzero(np.arange(len(at)) + length <= first[doc + 1])
    if not len(run):
        return none, none, none, none, none.view(np.uint64)
    own = at[run]
    new = np.flatnonzero(np.append(True, (run[1:] != run[:-1] + 1) | (own[1:] != own[:-1])))
    last = np.append(new[1:], len(run)) - 1
    d = doc[run[new]]
    return d, run[new] - first[d], run[last] - first[d], own[new] - first[d], g[own[new]]


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        unit = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = X.string_buffer(batch.column(2))
        for i, j in X.slices(offsets):
            w = X.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            d, s, e, p, g = anchors(w.hash, w.first)
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(unit[i + d]), *(pa.array(x.astype(np.int32)) for x in (s, e, p))], ["g", "unit", "s", "e", "p"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by g, those whose g occurs again."""
    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        g = now.column(0).to_numpy(zero_copy_only=False)
        same = np.append(False, g[1:] == g[:-1])
        same[0] = before is not None and g[0] == before
        keep = same.copy()
        keep[:-1] |= same[1:]
        yield now.slice(0, len(g) - 1).filter(pa.array(keep[:-1])).select([1, 2, 3, 4])
        held = now.slice(len(g) - 1)
        before = g[-2] if len(g) > 1 else before
    if held is not None:
        yield held.filter(pa.array([before is not None and held.column(0)[0].as_py() == before])).select([1, 2, 3, 4])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor's head and words, parted by single blanks.

    Of equal texts a task sends the first two with their words, and then only such as lie before
    all others so far; the rest are known to be later occurrences and go without words, their
    salt spreading them over the ranges. A passage in any number of documents so brings a few rows a task.
    A row that repeats another brings the same places; they are no occurrences of their own.
    """
    seen: dict[bytes, list] = {}
    for batch in batches:
        data, offsets = X.string_buffer(batch.column(2))
        units, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        runs = batch.column(3)
        flat, count = runs.flatten(), np.asarray(runs.value_lengths(), np.int64)
        s, e, p = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        at = np.append(0, np.cumsum(count))
        for i, j in X.slices(offsets):
            own = data[offsets[i] : offsets[j]]
            w = X.words(own, offsets[i : j + 1] - offsets[i], hashes=False)
            k = np.arange(at[i], at[j])
            doc = np.repeat(np.arange(i, j), count[i:j])
            base = w.first[doc - i]
            begin, head = w.start[base + s[k]], w.start[base + p[k]]
            head_end, end = w.end[base + p[k] + GRAM - 1], w.end[base + e[k] + LENGTH - 1]
            raw = own.tobytes()
            kept, salts, heads, words = np.ones(len(k), bool), np.zeros(len(k), np.int64), [], []
            for n, (a, b, c, d, place) in enumerate(zip(begin.tolist(), end.tolist(), head.tolist(), head_end.tolist(), zip(ids[doc].tolist(), units[doc].tolist(), s[k].tolist()))):
                heads.append(b" ".join(raw[c:d].split()))
                text = b" ".join(raw[a:b].split())
                known = seen.setdefault(blake2b(text + (p[k[n]] - s[k[n]]).tobytes(), digest_size=16).digest(), [0, place])
                if known[0] and place == known[1]:
                    kept[n] = False
                    words.append(b"")
                    continue
                known[0] += 1
                if known[0] > 2 and place >= known[1]:
                    salts[n] = 1 + place[1] % (1 << 30)
                    words.append(b"")
                    continue
                known[1] = min(known[1], place)
                words.append(text)
            index = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(salts), batch.column(0).take(index), batch.column(1).take(index), *(pa.array(x[k].astype(np.int32)) for x in (s, e, p)), pa.array(words, pa.binary())], ["head", "salt", "unit", "doc_id", "s", "e", "p", "words"]).filter(pa.array(kept))


def multikey_quicksort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of keys (depth, n), and how many leading keys each has in common with the one before it.

    All groups of rows that agree so far are partitioned by the next key at once; groups of one are done.
    """
    depth, n = keys.shape
    order, common = np.arange(n), np.zeros(n, np.int64)
    at, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(depth):
        if not len(at):
            break
        k = keys[d][order[at]]
        by = np.lexsort((k, group))
        order[at], k = order[at][by], k[by]
        starts = np.append(True, group[1:] != group[:-1])
        splits = np.append(False, k[1:] != k[:-1]) & ~starts
        common[at[splits]] = d
        group = np.cumsum(starts | splits)
        size = np.bincount(group)[group]
        at, group = at[size > 1], group[size > 1]
    if len(at):
        common[at[np.append(False, group[1:] == group[:-1])]] = depth
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth) if depth else 0
    return out


def repeated_runs(hashes: np.ndarray, first: np.ndarray, s: np.ndarray, e: np.ndarray, p: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, start, later) of the runs that occur more than once; later: in an earlier record, or earlier in the same, too.

    Records are in order of place; first has where each record's words begin in hashes.
    """
    n, left_most = len(s), length - 1
    position = first[:-1] + p - s
    right, left = np.zeros((length, n), np.uint64), np.zeros((left_most, n), np.uint64)
    for d in range(length):
        there = position + d < first[1:]
        right[d, there] = hashes[position[there] + d]
    deepest = int((p - s).max(initial=0))
    for d in range(deepest):
        there = position - d - 1 >= first[:-1]
        left[d, there] = hashes[position[there] - d - 1]
    right_order, right_common = multikey_quicksort(right)
    left_order, left_common = multikey_quicksort(left[:deepest])
    found = []
    for a in range(deepest + 1):
        own = np.flatnonzero((p - e <= a) & (p - s >= a))
        if len(own) < 2:
            continue
        both = _classes(right_order, right_common, length - a)[own] * (n + 1) + _classes(left_order, left_common, a)[own]
        by = np.argsort(both, kind="stable")
        same = np.append(False, both[by][1:] == both[by][:-1])
        again = same.copy()
        again[:-1] |= same[1:]
        found.append(np.stack([own[by][again], p[own[by][again]] - a, same[again].astype(np.int64)]))
    rows = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return rows[0], rows[1], rows[2].astype(bool)


def _numbers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word among the distinct words of all texts, parted by single blanks, and where each text's begin."""
    lists = pa.compute.split_pattern(words.cast(pa.large_string()), " ")
    return lists.flatten().dictionary_encode().indices.to_numpy().astype(np.uint64), np.append(0, np.cumsum(np.asarray(lists.value_lengths(), np.int64)))


def _sorted(table: pa.Table) -> pa.RecordBatch:
    """The repeated runs of the records of some heads."""
    table = table.sort_by([("doc_id", "ascending"), ("unit", "ascending"), ("s", "ascending")]).combine_chunks()
    unit, doc, s, e, p = (table.column(k).to_numpy() for k in ("unit", "doc_id", "s", "e", "p"))
    new = np.append(True, (unit[1:] != unit[:-1]) | (doc[1:] != doc[:-1]) | (s[1:] != s[:-1]))
    unit, doc, s, e, p = (x[new].astype(np.int64) for x in (unit, doc, s, e, p))
    numbers, first = _numbers(table.column("words").combine_chunks().filter(pa.array(new)))
    record, start, later = repeated_runs(numbers + np.uint64(1), first, s, e, p)
    by = np.lexsort((start, later, record))
    record, start, later = record[by], start[by], later[by]
    head = np.flatnonzero(np.append(True, (record[1:] != record[:-1]) | (later[1:] != later[:-1]) | (start[1:] != start[:-1] + 1))) if len(record) else np.zeros(0, np.int64)
    end = start[np.append(head[1:], len(start)) - 1] + LENGTH if len(head) else np.zeros(0, np.int64)
    r = record[head]
    return pa.RecordBatch.from_arrays([pa.array(unit[r]), pa.array(doc[r]), pa.array(start[head].astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(later[head])], _SPAN)


_SPAN = ["unit", "doc_id", "start_word", "end_word", "later"]


def _ranges(chunk_bytes: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by head and salt: whole heads, some at a time."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            known = np.asarray(batch.column(1)) > 0
            if known.any():
                own = batch.filter(pa.array(known))
                end = np.asarray(own.column(5)) + LENGTH
                yield pa.RecordBatch.from_arrays([own.column(2), own.column(3), own.column(4), pa.array(end.astype(np.int32)), pa.array(np.ones(len(end), bool))], _SPAN)
            batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            heads = batch.column(0)
            new = np.flatnonzero(np.asarray(pa.compute.not_equal(heads[1:], heads[:-1]))) + 1
            if held and held[-1].column(0)[-1].as_py() != heads[0].as_py():
                new = np.append(0, new)
            if size + batch.nbytes > chunk_bytes and len(new):
                yield _sorted(pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))]))
                batch, held, size = batch.slice(int(new[-1])), [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield _sorted(pa.Table.from_batches(held))

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, start_word, end_word, first_occurrence): the words covered by runs of LENGTH words that occur more than once.

    Words are parted by ASCII white space and compared byte by byte, within and across
    documents. Runs that occur before (in a lower id, or earlier in the document) are
    covered by rows with first_occurrence false, which may be removed; the first of each
    by rows with true. Overlapping and touching runs of a kind are one row. Null, empty
    and shorter texts have none; a text of any length is read whole, in memory of some ten times its
    size; rows without id are left out; rows that repeat id and text are one document, rows that share an
    id alone are two. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    rows = rows.select(F.xxhash64("doc_id", "text").alias("unit"), "doc_id", "text")
    found = rows.mapInArrow(_anchor_batches, "g long, unit long, s int, e int, p int").repartition("g").sortWithinPartitions("g")
    again = found.mapInArrow(_repeated, "unit long, s int, e int, p int").groupBy("unit").agg(F.collect_set(F.struct("s", "e", "p")).alias("runs"))
    cut = rows.join(again, "unit").select("unit", "doc_id", "text", "runs").mapInArrow(_cut, "head binary, salt long, unit long, doc_id long, s int, e int, p int, words binary")
    cut = cut.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "head", "salt").sortWithinPartitions("head", "salt")
    runs, _ = materialize(cut.mapInArrow(_ranges(chunk_bytes), "unit long, doc_id long, start_word int, end_word int, later boolean"), "repeated-runs")
    own = Window.partitionBy("doc_id", "unit", "later").orderBy("start_word", "end_word")
    before = F.max("end_word").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = runs.withColumn("new", F.when(before.isNull() | (F.col("start_word") > before), 1).otherwise(0)).withColumn("island", F.sum("new").over(own))
    spans = spans.groupBy("doc_id", "unit", "later", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    return spans.select("doc_id", "start_word", "end_word", (~F.col("later")).alias("first_occurrence"))
