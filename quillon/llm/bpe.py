"""Byte-level BPE through a table of distinct words.

Spark splits the texts into words (the tokenizer's own pre-tokens), and each distinct word
is encoded once. The words' ids are joined back by position: the table is written sorted by
a 64-bit word hash into the shared folder, and every task merge-joins its words with the
memory-mapped shards it needs, so neither texts nor words are shuffled. A table above
MAP_SIDE_BYTES, two words of one hash, or a shared folder that is no file system of the workers, take a
shuffled join on the word instead. Decoding joins ids with the vocabulary's pieces: of each distinct
word where texts are encoded, so that a text decodes to itself if its words do, and of whole texts in
decode().
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import textnp as X
from quillon.llm.names import fresh
from quillon.session import discard, materialize, scratch_path

VOCABULARY = os.environ.get("QUILLON_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Largest word table that tasks map into memory; it is 16 bytes a word and 4 a token.
MAP_SIDE_BYTES = 8 << 30
SHARD_WORDS = 1 << 19
#: Copies of a word's row in the shuffled join, among which its texts are spread.
SALTS = 16
_BLANK = r"\t-\r \u0085   -     　"
WORD = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"


def _ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(maxsize=4)
def _encoder(vocabulary: str):  # noqa: ANN202
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(vocabulary), special_tokens={})  # a word is never split again


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return X.span_hash(X.prefix_hash(data), offsets[:-1], offsets[1:])


def word_table(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """(word, hash, ids) of the distinct words."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoder(vocabulary).encode_ordinary
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [one(w) for w in words]
            data, offsets = X.string_buffer(batch.column(0))
            at = offsets - offsets[0]
            hashes = word_hash(data[offsets[0] : offsets[-1]], at).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes), pa.array(ids, pa.list_(pa.int32()))], ["word", "hash", "ids"])

    words = docs.select(F.explode(split_words(F.col(text_col).cast("string"))).alias("word")).distinct()
    return words.mapInArrow(encode, "word string, hash long, ids array<int>")


def decoded(table: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """word_table() with back: the word that its ids give, by a join of ids with pieces; the vocabulary's size is fixed."""
    placed = table.select("word", "hash", "ids", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(vocabulary_table(table.sparkSession, vocabulary)), "id", "left")
    return placed.groupBy("word", "hash", "ids").agg(_joined(F.collect_list(F.struct("pos", "piece"))).alias("back"))


def _joined(pieces: Column) -> Column:
    """The bytes of (pos, piece) pairs in order; ids without a piece give nothing."""
    return F.unhex(F.array_join(F.transform(F.array_sort(pieces), lambda x: F.hex(F.coalesce(x["piece"], F.lit(b"")))), ""))


def _write_shard(folder: str):  # noqa: ANN202
    def write(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        rows = rows.take(pa.array(np.argsort(rows["hash"].to_numpy().view(np.uint64)))).combine_chunks()
        hashes = rows["hash"].to_numpy().view(np.uint64)
        ids = rows["ids"].combine_chunks()
        parts = {"hash": hashes, "end": np.cumsum(np.asarray(ids.value_lengths(), np.int64)), "ids": ids.flatten().to_numpy().astype(np.uint32), "same": np.asarray(rows["same"])}
        for name, values in parts.items():
            path = f"{folder}/{name}-{key[0].as_py()}.npy"
            with open(temporary := f"{path}.{os.getpid()}", "wb") as out:
                np.save(out, values)
            os.replace(temporary, path)  # a task that runs again writes the same
        return pa.table({"again": pa.array([int((hashes[1:] == hashes[:-1]).sum())])})

    return write


@lru_cache(maxsize=256)
def _shard(folder: str, k: int) -> tuple[np.ndarray, ...]:
    """Sorted hashes, where each one's ids end, ids, and whether they decode to the word."""
    return tuple(np.load(f"{folder}/{name}-{k}.npy", mmap_mode="r") for name in ("hash", "end", "ids", "same"))


def _join(folder: str, shards: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of sorted distinct hashes, one after another, where each one's begin, and whether they decode to the word."""
    part = ((wanted >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    flat, sizes, sames = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for k in np.unique(part):
        own = wanted[np.searchsorted(part, k) : np.searchsorted(part, k, "right")]
        hashes, end, ids, same = _shard(folder, int(k))
        at = np.searchsorted(hashes, own)
        if (at >= len(hashes)).any() or (hashes[at] != own).any():
            raise KeyError("a word is missing from the table")
        stop = end[at]
        start = np.where(at > 0, end[np.maximum(at - 1, 0)], 0)
        size = stop - start
        sizes.append(size)
        sames.append(same[at])
        flat.append(ids[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())])
    return np.concatenate(flat), np.append(0, np.cumsum(np.concatenate(sizes))), np.concatenate(sames)


def gather(values: np.ndarray, begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[begins[w]:begins[w + 1]] for each w in which, joined, and each one's size."""
    size = begins[which + 1] - begins[which]
    return values[np.repeat(begins[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


def _ids_array(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat.astype(np.int32)))


def _encode_batches(folder: str, shards: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, texts = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2)
            kept = batch.columns[:-2]
            count = np.asarray(words.value_lengths().fill_null(0), np.int64)
            data, offsets = X.string_buffer(words.flatten())
            raw, raw_at = X.string_buffer(texts)
            first = np.append(0, np.cumsum(count))
            step = 0
            while step < batch.num_rows:
                stop = max(step + 1, int(np.searchsorted(first, first[step] + 150_000, "right")) - 1)
                at = offsets[first[step] : first[stop] + 1]
                unique, inverse = np.unique(word_hash(data[at[0] : at[-1]], at - at[0]), return_inverse=True)
                flat, begins, same = _join(folder, shards, unique)
                ids, size = gather(flat, begins, inverse)
                per_doc = np.diff(np.append(0, np.cumsum(size))[first[step : stop + 1] - first[step]])
                bad = np.diff(np.append(0, np.cumsum(~same[inverse]))[first[step : stop + 1] - first[step]])
                # a text decodes to itself if its words do and, one after another, are the text
                whole = (offsets[first[step : stop + 1]] - at[0] == raw_at[step : stop + 1] - raw_at[step]).all() and data[at[0] : at[-1]].tobytes() == raw[raw_at[step] : raw_at[stop]].tobytes()
                lossless = bad == 0
                if not whole:
                    own = [data[offsets[first[k]] : offsets[first[k + 1]]].tobytes() == raw[raw_at[k] : raw_at[k + 1]].tobytes() for k in range(step, stop)]
                    lossless &= np.array(own)
                yield pa.RecordBatch.from_arrays([*(c.slice(step, stop - step) for c in kept), _ids_array(ids, per_doc), pa.array(per_doc), pa.array(lossless)], [*batch.schema.names[:-2], "ids", "n_tokens", "lossless"])
                step = stop

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", map_side_bytes: int = MAP_SIDE_BYTES) -> DataFrame:
    """The `keep` columns of each row with ids ARRAY<INT>, n_tokens and lossless (its ids decode to its text).

    Special tokens never arise: their strings are ordinary text. A null or empty text has
    no ids and is lossless; a text of any length is encoded whole. Rows that repeat are encoded each. Other
    columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table, path = materialize(word_table(docs, vocabulary, text_col), "words")
    n, tokens = table.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    folder = scratch_path(spark, "word-shards")
    local = folder.removeprefix("file://") if "://" in folder else folder
    checked = decoded(table, vocabulary).select("word", "hash", "ids", (F.col("back") == F.encode("word", "UTF-8")).alias("same"))
    if "://" in local or n * 17 + tokens * 4 > map_side_bytes:
        return _encode_shuffled(docs, checked, keep, text_col)
    os.makedirs(local, exist_ok=True)
    shards = max(1, -(-n // SHARD_WORDS))
    shard = F.shiftright(F.shiftrightunsigned("hash", 32) * shards, 32).cast("int")
    again = checked.select("hash", "ids", "same", shard.alias("shard")).groupBy("shard").applyInArrow(_write_shard(local), "again long").agg(F.sum("again")).first()[0]
    if again:  # two words share a hash
        return _encode_shuffled(docs, checked, keep, text_col)
    discard(spark, path)
    words, text = fresh(docs, "bpe_words", "bpe_text")
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(text), split_words(F.col(text_col).cast("string")).alias(words))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return rows.mapInArrow(_encode_batches(local, shards), f"{schema}, ids array<int>, n_tokens long, lossless boolean")


def _encode_shuffled(docs: DataFrame, table: DataFrame, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """Distinct texts' words joined with the table (word, ids, same) by shuffle, collected by text in order of position.

    A text sends each of its words once, with all its places, so that the commonest come once a
    text; they are spread over SALTS copies of their row in the table.
    """
    key, own = fresh(docs, "bpe_key", "bpe_text")
    texts = docs.select(F.col(text_col).cast("string").alias("t")).filter("t <> ''").distinct().withColumn("k", F.sha2("t", 256))
    words = texts.select("k", "t", split_words(F.col("t")).alias("w")).select("k", F.posexplode("w").alias("pos", "word"))
    words = words.groupBy("k", "word").agg(F.collect_list("pos").alias("places")).withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)))
    table = table.select("word", "ids", "same", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    placed = words.join(table, ["word", "salt"]).select("k", F.explode("places").alias("pos"), "ids", "same", "word")
    ids = placed.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "ids", "word"))).alias("s"), F.bool_and("same").alias("same"))
    ids = ids.select("k", F.flatten(F.col("s.ids")).alias("ids"), "same", F.array_join(F.col("s.word"), "").alias("back"))
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(own)).withColumn(key, F.sha2(own, 256))
    rows = rows.join(ids, F.col(key) == F.col("k"), "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    lossless = F.coalesce(F.col("same") & (F.col("back") == F.col(own)), F.coalesce(F.col(own), F.lit("")) == "")
    return rows.select(*keep, "ids", F.size("ids").cast("long").alias("n_tokens"), lossless.alias("lossless"))


def vocabulary_table(spark, vocabulary: str = VOCABULARY) -> DataFrame:  # noqa: ANN001
    """(id, piece): the vocabulary, of fixed size whatever the corpus."""
    return spark.createDataFrame(pd.DataFrame([(k, p) for p, k in _ranks(vocabulary).items()], columns=["id", "piece"]), "id int, piece binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) from (doc_id, ids) by a join of ids with pieces; rows that share an id must not.

    The vocabulary's size is fixed, so it is broadcast. No ids give the empty text, ids outside
    the vocabulary give nothing, and bytes that are no UTF-8 become U+FFFD.
    """
    placed = encoded.select(F.col(id_col).alias("doc_id"), F.posexplode_outer("ids").alias("pos", "id"))
    joined = placed.join(F.broadcast(vocabulary_table(encoded.sparkSession, vocabulary)), "id", "left")
    return joined.groupBy("doc_id").agg(F.decode(_joined(F.collect_list(F.struct("pos", "piece"))), "UTF-8").alias("text"))
