"""Toxicity by lexicon induction: random walks from labelled seed terms over a PPMI word graph.

Seeds are the terms whose labelled documents are toxic, or clean, far more often than
chance. Two walks with restart start from them over the graph whose edge weights are
positive pointwise mutual information of words within WINDOW places, counted over all
documents and for all words of the vocabulary. A walk pushes mass from every word, until
hardly any moves. A word's polarity compares the mass of both walks with each other
and with its share of the corpus, and is scaled by its labelled documents' toxic share, as
a rare word near a seed is no evidence; documents are scored by their words' polarity. Words
with few labelled documents or none are judged once more, by all their documents: those
without label count as what the words found so far make of them.

Vocabulary, edges and the texts as numbers of words are tables. A step of the walks multiplies the edges, where
they are, by the words' mass, which goes to the tasks and comes back summed by ranges of words; the driver holds hash,
count and mass of each word of the vocabulary, some 50 bytes each, and the words of the least polarity.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textnp as X
from quillon.session import discard, materialize

#: A graph word is in at least 5 documents, whatever their number (no least share), and in at most MOST_SHARE of them.
LEAST_SHARE, MOST_SHARE = 0.0, 0.3
WINDOW = 25
#: An edge has 3 occurrences, whatever its words' (no least share).
LEAST_EDGE = 0.0
#: Labelled documents, at most, from which seeds and the score's threshold are taken.
SAMPLE = 20_000
SEED_Z, SEED_ODDS = 3.5, 2.0
#: The walks push mass from every word that holds any (no least mass), ROUNDS times: 0.05 % of it is then still moving, and stays where it is.
RESTART, ROUNDS, LEAST_MASS = 0.4, 14, 0.0
LEAST_POLARITY = 0.5
#: A word's polarity is scaled by the toxic share of its labelled documents, with this many of average toxicity added; with fewer labelled ones, of all its documents.
PRIOR = 6.0
#: Pairs that a task holds before it hands on their counts.
_PAIRS = 6_000_000
#: Pairs are counted in so many passes over the words' numbers, each for a share of the words, as the disk holds not all of them at once.
PASSES = 8
#: Edges, at least, that a task multiplies at once, and words whose sums make one row.
_EDGES, _RANGE = 1 << 20, 1 << 15


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _each(column: pa.Array, most: int = X.SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, X.Words]]:
    data, offsets = X.string_buffer(column)
    for i, j in X.slices(offsets, most):
        own = data[offsets[i] : offsets[j]]
        folded = X.fold(own)
        yield i, j, folded, X.words(folded, offsets[i : j + 1] - offsets[i], X.NON_WORD)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, w in _each(batch.column(0)):
            if not len(w.hash):
                continue
            order = np.argsort(w.hash, kind="stable")  # of one word, by text
            h, doc = w.hash[order], w.doc[order]
            new = np.append(True, h[1:] != h[:-1])
            at = np.flatnonzero(new)
            df = np.add.reduceat((new | np.append(True, doc[1:] != doc[:-1])).astype(np.int64), at)
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(w.start[order[at]].tolist(), w.end[order[at]].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(words, pa.binary()), pa.array(df), pa.array(np.diff(np.append(at, len(h))))], ["h", "word", "df", "n"])


def vocabulary(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(h, word, n) of the graph's words; hashes (sorted) of the words in too many documents; words in all."""
    counted = _rows(docs).select("text").mapInArrow(_count_words, "h long, word binary, df long, n long")
    counted, path = materialize(counted.groupBy("h").agg(F.min("word").alias("word"), F.sum("df").alias("df"), F.sum("n").alias("n")), "word-counts")
    documents, total = docs.count(), counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = F.col("df") <= max(20, MOST_SHARE * documents)
    usual = counted.filter(~most).select("h").toArrow()  # at most 1 / MOST_SHARE times a document's mean distinct words
    known, _ = materialize(counted.filter((F.col("df") >= 5) & most).select("h", "word", "n"), "vocabulary")
    discard(docs.sparkSession, path)
    return known, _hashes(usual["h"]), int(total)


def _hashes(column: pa.ChunkedArray) -> np.ndarray:
    return np.sort(column.to_numpy().astype(np.int64).view(np.uint64))


def _places(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return np.where(known[at] == h, at, -1) if len(known) else np.full(len(h), -1)


def _chosen(labels: DataFrame, most: int) -> DataFrame:
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "labelled_id")


def numbered(docs: DataFrame, labels: DataFrame, h: np.ndarray, most: int = SAMPLE) -> tuple[DataFrame, str]:
    """Each row of docs as (doc_id, toxic, low, middle, high) and the table's path: toxic is null but for `most` labelled
    documents at most; the rest are the bytes of the number of each of its words: place in h plus 1, or 0 for words not in h."""
    order = np.argsort(h)
    known = h[order]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, w in _each(batch.column(2)):
                place = _places(w.hash, known)
                code = np.where(place >= 0, order[place] + 1, 0) if len(known) else np.zeros(len(place), np.int64)
                parts = [(code & 0xFF).astype(np.uint8), (code >> 8 & 0xFF).astype(np.uint8), (code >> 16).astype(np.uint16)]
                columns = [pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((w.first * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *columns], ["doc_id", "toxic", "low", "middle", "high"])

    rows = _rows(docs).join(F.broadcast(_chosen(labels, most)), F.col("doc_id") == F.col("labelled_id"), "left")  # at most `most` rows
    rows = rows.select("doc_id", "toxic", "text").mapInArrow(number, "doc_id long, toxic int, low binary, middle binary, high binary")
    return materialize(rows, "numbered", compression="zstd")


def _numbers(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (-1 for words not known) and text of each word, from low, middle and high."""
    parts = []
    for column, kind in zip(columns, (np.uint8, np.uint8, np.uint16), strict=True):
        column = column.cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        parts.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None else np.zeros(0, kind))
        if len(parts) == 1:
            size = np.diff(at)
    low, middle, high = parts
    return (low + (middle.astype(np.int32) << 8) + (high.astype(np.int32) << 16) - 1).astype(np.int32), np.repeat(np.arange(len(size)), size)


def labelled(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of clean and toxic labelled documents; the words in them, by number, and in how many toxic and how many of all they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            i, doc = _numbers(batch.columns[1:])
            width = int(i.max(initial=0)) + 1
            code = np.unique(doc[i >= 0] * width + i[i >= 0])
            word, inverse = np.unique(code % width, return_inverse=True)
            t = np.bincount(inverse, toxic[code // width], len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(t), pa.array(np.bincount(inverse, minlength=len(word)))], ["i", "t", "n"])

    rows = tokens.filter("toxic is not null")
    words = rows.select("toxic", "low", "middle", "high").mapInArrow(count, "i long, t long, n long").groupBy("i").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).toArrow()  # words of a sample
    size = dict(rows.groupBy("toxic").count().collect())
    return np.array([size.get(0, 0), size.get(1, 0)]), *(words[x].to_numpy() for x in "itn")


def seeds(t: np.ndarray, n: np.ndarray, C: int, T: int) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and clean seed words: by the z-score of the log odds of their labelled documents."""
    c = n - t
    odds = np.log((t + 0.5) / (T - t + 0.5)) - np.log((c + 0.5) / (C - c + 0.5))
    z = odds / np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    bad = np.flatnonzero((z >= SEED_Z) & (odds >= SEED_ODDS))
    good = np.flatnonzero((odds < 0) & (n >= 5))
    return bad, good[np.argsort(z[good], kind="stable")[: max(50, len(bad))]]


def _padded(i: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The numbers with WINDOW places of -1 before, between and after texts, which no window crosses."""
    place = np.full(len(i) + WINDOW * (int(doc[-1]) + 2 if len(doc) else 2), -1, np.int32)
    place[np.arange(len(i)) + WINDOW * (doc + 1)] = i
    return place


def _near(places: Iterator[np.ndarray], base: np.ndarray, once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted base[a] + b and counts: how often the words a, of a base of 0 or more, and b are near each other; with `once` for b < a alone."""
    raw, size = [], 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        code = np.concatenate(raw)
        raw.clear()
        code.sort()
        at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        return code[at], np.diff(np.append(at, len(code)))

    base = np.append(base, -1)  # place -1
    for place in places:
        if len(place) <= 2 * WINDOW:
            continue
        near = np.lib.stride_tricks.sliding_window_view(place, 2 * WINDOW + 1)
        centre = np.flatnonzero(base[place[WINDOW:-WINDOW]] >= 0)
        for k in range(0, len(centre), 1 << 15):
            b = near[centre[k : k + (1 << 15)]]
            a = b[:, WINDOW].copy()
            if once:
                own = b.view(np.uint32) < a.view(np.uint32)[:, None]  # -1 is no less than any
            else:
                own = b >= 0
                own[:, WINDOW] = False
            code = np.repeat(base[a], own.sum(1)) + b[own]
            raw.append(code)
            size += len(code)
            if size > _PAIRS:
                yield fold()
                size = 0
    if size:
        yield fold()


def _count_pairs(known: np.ndarray, active: np.ndarray):  # noqa: ANN202
    """(code, n) of texts: how often the active word a and the word b are near each other, by a * len(known) + b."""
    base = np.full(len(known), -1, np.int64)
    base[active] = np.asarray(active, np.int64) * len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = (_padded(_places(w.hash, known), w.doc) for batch in batches for *_, w in _each(batch.column(0)))
        for code, count in _near(places, base):
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], ["code", "n"])

    return run


def _pack(code: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted codes and counts, in some 2 bytes a pair."""
    gap = np.diff(code, prepend=0)
    wide, many = gap >= 0xFFFF, count >= 0xFF
    head = np.array([len(code), wide.sum()], np.int64)
    short = np.where(wide, 0xFFFF, gap)
    raw = b"".join(x.tobytes() for x in (head, gap[wide], count[many].astype(np.int64), (short & 0xFF).astype(np.uint8), (short >> 8).astype(np.uint8), np.where(many, 0xFF, count).astype(np.uint8)))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    n, wide = np.frombuffer(raw, np.int64, 2).tolist()
    low, high, count = (np.frombuffer(raw, np.uint8, n, len(raw) - k * n).astype(np.int64) for k in (3, 2, 1))
    gap = low + (high << 8)
    gap[gap == 0xFFFF] = np.frombuffer(raw, np.int64, wide, 16)
    many = count == 0xFF
    count[many] = np.frombuffer(raw, np.int64, int(many.sum()), 16 + 8 * wide)
    return np.cumsum(gap), count


def _together(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sums of their counts."""
    keys, rest = [np.zeros(0, np.int64)], []
    for code, count in map(_unpack, packed):
        keys.append(code << 8 | np.minimum(count, 0xFF))
        while (count > 0xFF).any():  # a count above a byte is the sum of several
            code, count = code[count > 0xFF], count[count > 0xFF] - 0xFF
            rest.append(code << 8 | np.minimum(count, 0xFF))
    key = np.concatenate(keys + rest)
    key.sort()
    code = key >> 8
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[at], np.add.reduceat(key & 0xFF, at) if len(at) else key


def graph(tokens: DataFrame, n: np.ndarray, total: int) -> tuple[DataFrame, list[str]]:
    """Packed (a * len(n) + b, occurrences) of every edge b < a, and the tables' paths: 3 or more occurrences and positive PMI. n: the words' counts."""
    spark, size = tokens.sparkSession, len(n)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = -(-size // (PASSES * parts))  # words of a part, in a pass
    edges, paths = None, []
    for k in range(PASSES):

        def send(batches: Iterator[pa.RecordBatch], k=k) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            q, base = np.arange(-(-(size - k) // PASSES)), np.full(size, -1, np.int64)
            base[k::PASSES] = (q % parts * rows + q // parts) * size  # word k + PASSES * q is row q // parts of part q % parts
            cuts = np.arange(parts + 1) * rows * size
            for code, count in _near((_padded(*_numbers(batch.columns)) for batch in batches), base, once=True):
                at = np.searchsorted(code, cuts)
                own = np.flatnonzero(np.diff(at))
                packed = [_pack(code[at[p] : at[p + 1]] - cuts[p], count[at[p] : at[p + 1]]) for p in own]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], ["part", "pairs"])

        def keep(batches: Iterator[pa.RecordBatch], k=k) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            packed: dict[int, list[bytes]] = {}
            for batch in batches:
                for part, pairs in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    packed.setdefault(part, []).append(pairs)
            for part in sorted(packed):
                code, count = _together(packed.pop(part))
                good = count >= 3
                code, count = code[good], count[good]
                row = code // max(1, size)
                code += ((row * parts + part) * PASSES + k - row) * size
                good = _ppmi(code, count, n, total) > 0
                code, count = code[good], count[good]
                if len(code):
                    yield pa.RecordBatch.from_arrays([pa.array([_pack(code[i : i + _PAIRS], count[i : i + _PAIRS]) for i in range(0, len(code), _PAIRS)], pa.binary())], ["edges"])

        found = tokens.select("low", "middle", "high").mapInArrow(send, "part int, pairs binary").repartitionById(parts, "part")
        own, path = materialize(found.mapInArrow(keep, "edges binary"), "walk-edges")
        edges = own if edges is None else edges.union(own)
        paths.append(path)
        del found
        _collect(spark)
    return edges, paths


def _collect(spark: SparkSession) -> None:
    """Shuffle files that nothing reads any more go once the driver has collected what refers to them."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def _ppmi(code: np.ndarray, count: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
    size = max(1, len(n))
    return np.log(count * float(total) / (n[code // size].astype(float) * n[code % size] * (2 * WINDOW)))


def step(edges: DataFrame, n: np.ndarray, total: int, x: np.ndarray) -> np.ndarray:
    """The graph's matrix of PPMI times x, (words, columns)."""
    size, columns, tasks = len(n), x.shape[1], edges.sparkSession.sparkContext.defaultParallelism
    if not size:
        return np.zeros(x.shape)

    def multiply(found: list[tuple[np.ndarray, np.ndarray]], logs: np.ndarray, out: np.ndarray) -> None:
        code, count = (np.concatenate(c) for c in zip(*found, strict=True))
        a = code // size
        b = code - a * size
        at = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        own, many = a[at], np.diff(np.append(at, len(a)))
        ppmi = np.log(np.arange(1, 257))[np.minimum(count, 256) - 1]
        ppmi[count > 256] = np.log(count[count > 256])
        ppmi -= np.repeat(logs[own] - np.log(total / (2 * WINDOW)), many)
        ppmi -= logs[b]
        for j in range(columns):
            out[j] += np.bincount(b, ppmi * np.repeat(x[own, j], many), size)
            np.add.at(out[j], own, np.add.reduceat(ppmi * x[b, j], at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, logs, found, held = np.zeros((columns, size)), np.log(n), [], 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                found.append(_unpack(packed))
                held += len(found[-1][0])
                if held >= max(_EDGES, size // 4):
                    multiply(found, logs, out)
                    found, held = [], 0
        if held:
            multiply(found, logs, out)
        for k in range(0, size, _RANGE):
            part = out[:, k : k + _RANGE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _RANGE], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["k", "sums"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                sums[k] = np.frombuffer(part) + sums.get(k, 0)
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["k", "sums"])

    kind = "k int, sums binary"
    few = edges.coalesce(tasks).mapInArrow(run, kind)  # each task hands on its sums of all words
    got = few.repartitionById(min(tasks, -(-size // _RANGE)), "k").mapInArrow(together, kind).toArrow()
    out = np.zeros(x.shape)
    for k, part in zip(got["k"].to_pylist(), got["sums"].to_pylist(), strict=True):
        out[k * _RANGE : (k + 1) * _RANGE] = np.frombuffer(part).reshape(columns, -1).T
    return out


def _table(docs: DataFrame, columns: dict[str, np.ndarray], schema: str) -> DataFrame:
    return docs.sparkSession.createDataFrame(pa.table(columns), schema)


def _words(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the graph's words, the most frequent first: 16 bytes each."""
    got = known.select("h", "n").toArrow()
    h, n = got["h"].to_numpy().astype(np.int64).view(np.uint64), got["n"].to_numpy()
    order = np.lexsort((h, -n))
    return h[order], n[order]


def transitions(docs: DataFrame, known: DataFrame, usual: np.ndarray, total: int, active: DataFrame, hashes: np.ndarray) -> DataFrame:  # noqa: ARG001
    """(a, b, p): the walk's steps that leave the words of these hashes: PPMI, scaled to sum to one."""
    h, n = _words(known)
    tokens, _ = numbered(docs, _table(docs, {"doc_id": np.zeros(0, np.int64), "toxic": np.zeros(0, np.int32)}, "doc_id long, toxic int"), h)
    edges, _ = graph(tokens, n, total)
    whole, own = step(edges, n, total, np.ones((len(h), 1)))[:, 0], np.isin(h, hashes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                code, count = _unpack(packed)
                ppmi = _ppmi(code, count, n, total)
                for a, b in ((code // len(h), code % len(h)), (code % len(h), code // len(h))):
                    k = own[a]
                    yield pa.RecordBatch.from_arrays([pa.array(h[a[k]].view(np.int64)), pa.array(h[b[k]].view(np.int64)), pa.array(ppmi[k] / whole[a[k]])], ["a", "b", "p"])

    return edges.mapInArrow(rows, "a long, b long, p double")


def polarity(tokens: DataFrame, n: np.ndarray, total: int, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Of each word, -1 to 1; n: the words' counts, bad and good: the seeds' numbers."""
    edges, paths = graph(tokens, n, total)
    whole = step(edges, n, total, np.ones((len(n), 1)))
    moving = np.stack([np.isin(np.arange(len(n)), x) / max(1, len(x)) for x in (bad, good)], 1)
    mass, moving = RESTART * moving, (1 - RESTART) * moving
    for k in range(ROUNDS):
        new = step(edges, n, total, np.divide(moving, whole, out=np.zeros(moving.shape), where=whole > 0))
        mass, moving = mass + RESTART * new, (1 - RESTART) * new
        if k % 4 == 3:
            _collect(tokens.sparkSession)
    mass += moving
    for path in paths:
        discard(tokens.sparkSession, path)
    return (mass[:, 0] - mass[:, 1]) / (mass.sum(1) + n / max(1, total))


def threshold(toxic: np.ndarray, score: np.ndarray) -> float:
    """The least score of a toxic document, by best F1; infinite if none has a score."""
    if not (score > 0).any():
        return float("inf")
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(len(order)) + 1 + toxic.sum())
    f1[np.append(score[order][1:] == score[order][:-1], False)] = -1  # a threshold lies between scores
    low = score[order][int(np.argmax(np.where(score[order] > 0, f1, -1)))]
    return float((low + score[score < low].max(initial=0)) / 2)


def evidence(tokens: DataFrame, few: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and all documents of the words `few`, by number: by label in the sample, elsewhere by the words' weights and the least score."""
    which = np.full(len(weight) + 1, -1)
    which[few] = np.arange(len(few))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            i, doc = _numbers(batch.columns[1:])
            mark = np.where(label >= 0, label > 0, _score(weight, i, doc, len(label)) >= least)
            hit = which[i] >= 0
            code = np.unique(doc[hit] * len(few) + which[i[hit]])
            have, inverse = np.unique(code % len(few), return_inverse=True)
            t = np.bincount(inverse, mark[code // len(few)], len(have)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(t), pa.array(np.bincount(inverse, minlength=len(have)))], ["k", "t", "n"])

    got = tokens.select("toxic", "low", "middle", "high").mapInArrow(count, "k long, t long, n long").groupBy("k").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, len(few)))
    for x, name in enumerate("tn"):
        out[x, got["k"].to_numpy()] = got[name].to_numpy()
    return out[0], out[1]


def _score(weight: np.ndarray, i: np.ndarray, doc: np.ndarray, documents: int) -> np.ndarray:
    """Of each text, the sum of its words' weights; i: the words' numbers."""
    each = np.append(weight, 0)[i]  # -1 is no word
    hit = np.flatnonzero(each)
    return np.bincount(doc[hit], each[hit], documents).astype(float)  # of no words, it has whole numbers


def _least(tokens: DataFrame, weight: np.ndarray) -> float:
    """The threshold of the labelled rows."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_score(weight, *_numbers(batch.columns[1:]), batch.num_rows))], ["toxic", "score"])

    got = tokens.filter("toxic is not null").select("toxic", "low", "middle", "high").mapInArrow(score, "toxic int, score double").toArrow()  # two numbers a labelled document
    return threshold(got["toxic"].to_numpy(), got["score"].to_numpy())


def _weights(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray, float]:
    """The vocabulary, the numbered texts, each word's hash and weight, and the least score of a toxic document."""
    known, _, total = vocabulary(docs)
    h, count = _words(known)
    tokens, _ = numbered(docs, labels, h, most)
    (clean, toxic), i, t, n = labelled(tokens)
    order = np.argsort(h[i])
    i, t, n = i[order], t[order], n[order]
    bad, good = seeds(t, n, clean, toxic)
    if not len(bad):
        return known, tokens, h, np.zeros(len(h)), float("inf")
    _collect(docs.sparkSession)
    walk = polarity(tokens, count, total, i[bad], i[good])
    walk = np.where(walk >= LEAST_POLARITY, walk, 0)
    average = toxic / (clean + toxic)
    every = np.zeros((2, len(h)))
    every[:, i] = t, n
    t, n = every

    def weigh(t: np.ndarray, n: np.ndarray) -> np.ndarray:
        weight = walk * (t + PRIOR * average) / (n + PRIOR)
        return np.where(weight < LEAST_POLARITY, 0, weight)

    weight, few = weigh(t, n), np.flatnonzero((walk > 0) & (n < PRIOR))
    least = _least(tokens, weight)
    if weight.any() and len(few):
        t[few], n[few] = evidence(tokens, few, weight, least)
        weight = weigh(t, n)
        least = _least(tokens, weight)
    return known, tokens, h, weight, least


def lexicon(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, list[str], np.ndarray, float]:
    """Hashes (sorted), words and weights of the toxic words, and the least score of a toxic document."""
    known, _, h, weight, least = _weights(docs, labels, most)
    found = np.flatnonzero(weight)
    found = found[np.argsort(h[found])]
    own = known.join(_table(docs, {"h": h[found].view(np.int64)}, "h long"), "h").select("h", "word").toArrow()
    names = dict(zip(own["h"].to_pylist(), own["word"].to_pylist(), strict=True))
    return h[found], [names[k].decode("utf-8", "replace") for k in h[found].view(np.int64).tolist()], weight[found], least


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, score, toxic) for each row: the sum of its words' polarity weights, and whether it reaches the threshold.

    Words are lower-cased runs of letters and digits; the threshold is the best F1 on the
    labelled sample. Null and empty texts score 0; null ids stay; labels repeated for an id
    count once, with the greatest. Without toxic labelled documents or seeds, every score is 0 and
    none is toxic. Rows that repeat are scored each; documents of equal score share their fate. A text of
    any length is read whole, in memory of some twenty times its size. Other columns are ignored; an empty
    table gives no rows.
    """
    _, tokens, _, weight, least = _weights(docs, labels, most)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.round(_score(weight, *_numbers(batch.columns[1:]), batch.num_rows), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(total >= least)], ["doc_id", "score", "toxic"])

    return tokens.select("doc_id", "low", "middle", "high").mapInArrow(score, "doc_id long, score double, toxic boolean")
