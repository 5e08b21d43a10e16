"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. Every passage is encoded as a vector
(byte-class bigrams, hashed words, lengths, repetition) and embedded; attention weights
softmax(w . (tanh(V h) * sigmoid(U h))) are learned from document labels alone, and the
attention-weighted mean is scored. Only a sample of at most SAMPLE labelled documents, the
least by a hash of their id, is gathered for the fit; scoring runs on all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textnp as X

PASSAGE = 64
SAMPLE = 3000
#: A document is kept from this score on.
LEAST_SCORE = 0.5
_HASHED, _EXTRA = 64, 5
DIMENSIONS = 256 + _HASHED + _EXTRA

_CLASS = np.full(256, 12, np.uint8)
_CLASS[0:32] = 15
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 13
for _k, _chars in ((3, b" \t"), (4, b"\n\r"), (5, b".?"), (6, b",;:"), (7, b"|"), (8, b"!"), (9, b"#$%&*@^~+="), (10, b"\"'`"), (11, b"()[]{}<>"), (14, b"-_/\\")):
    _CLASS[list(_chars)] = _k


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, text of each) of all passages, in order; a text without words has none."""
    w = X.words(data, offsets, X.SPACE)
    if not len(w.start):
        return np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64)
    within = np.arange(len(w.start)) - w.first[w.doc]
    head = np.flatnonzero(within % PASSAGE == 0)
    doc = w.doc[head]
    begin = w.start[head]
    end = np.append(begin[1:], 0)
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = offsets[doc[last] + 1]
    n = len(head)
    out = np.zeros((n, DIMENSIONS), np.float32)
    for k in range(0, n, 4096):
        a, length = begin[k : k + 4096], (end - begin)[k : k + 4096]
        owner = np.repeat(np.arange(len(a)), length)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + a[owner]
        kind = _CLASS[data[at]].astype(np.int64)
        pair = (owner[1:] * 256 + kind[:-1] * 16 + kind[1:])[owner[1:] == owner[:-1]]
        out[k : k + 4096, :256] = np.bincount(pair, minlength=len(a) * 256).reshape(-1, 256) / np.maximum(1, length - 1)[:, None]
    size = np.diff(np.append(head, len(w.start)))
    own = np.repeat(np.arange(n), size)
    hashed = np.bincount(own * _HASHED + (w.hash >> np.uint64(58)).astype(np.int64), minlength=n * _HASHED).reshape(n, _HASHED)
    out[:, 256 : 256 + _HASHED] = hashed / size[:, None]
    order = np.lexsort((w.hash, w.doc))
    again = np.zeros(len(w.start), bool)
    again[order[1:]] = (w.hash[order[1:]] == w.hash[order[:-1]]) & (w.doc[order[1:]] == w.doc[order[:-1]])
    length = w.end - w.start
    out[:, -5] = np.add.reduceat(length, head) / size / 10
    out[:, -4] = np.add.reduceat(again.astype(np.int64), head) / size
    out[:, -3] = np.minimum(1, np.maximum.reduceat(length, head) / 50)
    out[:, -2] = size / PASSAGE
    out[:, -1] = np.add.reduceat((length == 1).astype(np.int64), head) / size
    return np.sqrt(out), doc


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    embed: np.ndarray  # (DIMENSIONS, H)
    bias: np.ndarray
    v: np.ndarray  # (H, L)
    u: np.ndarray
    w: np.ndarray
    head: np.ndarray
    offset: np.ndarray


def _forward(m: Model, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    size = np.diff(np.append(first, len(x)))
    h = np.maximum(x @ m.embed + m.bias, 0)
    t, g = np.tanh(h @ m.v), 1 / (1 + np.exp(-(h @ m.u)))
    e = np.clip((t * g) @ m.w, -30, 30)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
    a = e / np.repeat(np.add.reduceat(e, first), size)
    z = np.add.reduceat(a[:, None] * h, first)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "size": size, "p": 1 / (1 + np.exp(-np.clip(z @ m.head + m.offset, -30, 30)))}


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = 14, hidden: int = 32, attention: int = 16, bags: int = 64, seed: int = 1) -> Model:
    """Adam on the class-balanced log loss of bags; first has each bag's first row of features."""
    rng = np.random.default_rng(seed)
    scale = features.std(0) + 1e-3
    m = Model(features.mean(0), scale, rng.normal(0, (2 / DIMENSIONS) ** 0.5, (DIMENSIONS, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, attention)), rng.normal(0, hidden**-0.5, (hidden, attention)), rng.normal(0, attention**-0.5, attention), rng.normal(0, hidden**-0.5, hidden), np.zeros(1))
    x = np.clip((features - m.mean) / m.scale, -8, 8)
    ends = np.append(first[1:], len(x))
    balance = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    params = list(m[2:])
    one, two, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(first))
        for at in range(0, len(order), bags):
            pick = order[at : at + bags]
            rows = np.concatenate([np.arange(first[k], ends[k]) for k in pick])
            heads = np.cumsum([0, *(ends[pick] - first[pick])[:-1]])
            now, xs = Model(m.mean, m.scale, *params), x[rows]
            f = _forward(now, xs, heads)
            dp = (f["p"] - label[pick]) * balance[pick] / len(pick)
            dz = np.repeat(dp[:, None] * now.head, f["size"], axis=0)
            da = (dz * f["h"]).sum(1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, heads), f["size"]))
            dt, dg = de[:, None] * now.w * f["g"] * (1 - f["t"] ** 2), de[:, None] * now.w * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dz + dt @ now.v.T + dg @ now.u.T) * (f["h"] > 0)
            grads = [xs.T @ dh + 1e-4 * now.embed, dh.sum(0), f["h"].T @ dt, f["h"].T @ dg, (f["t"] * f["g"]).T @ de, f["z"].T @ dp, np.array([dp.sum()])]
            step += 1
            rate = 3e-3 * (1 - 0.9 * epoch / epochs)
            for k, g in enumerate(grads):
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                params[k] = params[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return Model(*(np.asarray(p, np.float32) for p in (m.mean, m.scale, *params)))


def score(model: Model, features: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Scores of n texts from their passages; 0 where a text has none."""
    out = np.zeros(n)
    if len(doc):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        out[doc[first]] = _forward(model, np.clip((features - model.mean) / model.scale, -8, 8), first)["p"]
    return out


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, first, label) of at most `most` labelled documents with words."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "labelled_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "label", "text")  # at most `most` rows

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.string_buffer(batch.column(2))
            for i, j in X.slices(offsets):
                f, doc = passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                parts = np.split(f.astype(np.float16), first[1:]) if len(first) else []
                own = pa.array(doc[first] + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "label", "features"])

    got = rows.mapInArrow(encode, "doc_id long, label int, features binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(x, np.float16).reshape(-1, DIMENSIONS) for x in got["features"].to_pylist()]
    sizes = np.array([len(x) for x in bags], np.int64)
    return (np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, DIMENSIONS), np.float32)), np.cumsum(sizes) - sizes, got["label"].to_numpy().astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    """None where the labels at hand don't name both a good and a bad document."""
    features, first, label = training_sample(docs, labels, most)
    return fit(features, first, label) if len(set(label.tolist())) == 2 else None


def _score_batches(model: Model | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.string_buffer(batch.column(batch.num_columns - 1))
            found = [np.zeros(0)]
            for i, j in X.slices(offsets):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                f, doc = passages(own, at)
                found.append(np.where(np.bincount(doc, minlength=j - i) > 0, 1.0, 0.0) if model is None else score(model, f, doc, j - i))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.round(np.concatenate(found), 6))], [*batch.schema.names[:-1], "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, score, keep) for each row: the probability that the document is good, and whether it reaches LEAST_SCORE.

    A null or empty text scores 0 and is not kept. Null ids stay null. Without labels of both
    classes nothing can be learned: every document with words scores 1. Labels repeated
    for an id count once, with the greatest; other columns are ignored. Rows that repeat, or share an id,
    are scored each. A text of any length is scored whole, in memory of some twenty times its size. An empty
    table gives no rows.
    """
    model = train(docs, labels, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score_batches(model), "doc_id long, score double").withColumn("keep", F.col("score") >= LEAST_SCORE)


def keep_good(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """docs, all columns whatever their names, without the rows whose text scores below LEAST_SCORE.

    Null and empty texts go; null ids and repeated rows are judged like others; texts of any length whole.
    Without labels of both classes every row with words stays. An empty table stays empty.
    """
    model = train(docs, labels, most)
    run = _score_batches(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            scored = next(run(iter([pa.RecordBatch.from_arrays([text], ["text"])])))
            yield batch.filter(pa.array(scored.column(0).to_numpy(zero_copy_only=False) >= LEAST_SCORE))

    return docs.mapInArrow(kept, docs.schema)
