"""Exact dedup against a minimal perfect hash over historical distinct digests.

The history's distinct SHA-256 digests are split into shards; each shard becomes one
row that holds a hash-and-displace function without empty slots, and in slot order the
full digests and the winners' locators (doc_id). A digest that is looked up is compared
with all 32 bytes in its slot, so a nonmember is never taken for a member. Nonmembers
are grouped among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.names import fresh
from quillon.llm.textnp import mix
from quillon.session import materialize

#: Digests in a shard: 40 bytes each, so a shard is under 3 MB at any corpus size.
SHARD_DIGESTS = 1 << 16
_INDEX = "shard long, n long, displaced binary, digests binary, locators binary"
_STEP = np.uint64(0xD1342543DE82EF95)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _parts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(digests[:, 1], 1), mix(digests[:, 2], 2)


def _slot(h: np.ndarray, displaced: np.ndarray, n: int) -> np.ndarray:
    tried = mix(h + displaced.astype(np.uint64) * _STEP, 3) % np.uint64(n)
    return np.where(displaced < 0, -displaced - 1, tried.astype(np.int64))


def build_mph(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by bucket, and the slot of each of n distinct digests ((n, 4) uint64)."""
    n = len(digests)
    buckets = max(1, n // 2)
    h0, h1 = _parts(digests)
    of = (h0 % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    start = np.searchsorted(of[order], np.arange(buckets + 1))
    size = np.diff(start)
    taken, displaced, slots = np.zeros(n, bool), np.zeros(buckets, np.int64), np.zeros(n, np.int64)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        own = order[start[b] : start[b + 1]]
        at, block = 0, 32
        while True:
            tries = np.arange(at, at + block, dtype=np.int64)
            where = _slot(h1[own][None, :], tries[:, None], n)
            good = ~taken[where].any(1)
            ranked = np.sort(where, 1)
            good &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
            if good.any():
                k = int(np.argmax(good))
                displaced[b], slots[own] = tries[k], where[k]
                taken[where[k]] = True
                break
            at += block
            block = min(block * 2, 4096)
            if at > 1 << 24:
                raise ValueError("digests in a shard must be distinct")
    alone, free = np.flatnonzero(size == 1), np.flatnonzero(~taken)
    slots[order[start[alone]]] = free
    displaced[alone] = -free - 1
    return displaced, slots


def probe_mph(displaced: np.ndarray, table: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The slot that holds each digest, or -1."""
    if not len(table) or not len(digests):
        return np.full(len(digests), -1)
    h0, h1 = _parts(digests)
    slot = _slot(h1, displaced[(h0 % np.uint64(len(displaced))).astype(np.int64)], len(table))
    return np.where((table[slot] == digests).all(1), slot, -1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint64).reshape(-1, 4)


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    digests, locators = _matrix(rows["digest"]), rows["winner"].to_numpy(np.int64)
    displaced, slots = build_mph(digests)
    by_slot = np.argsort(slots)
    return pd.DataFrame({"shard": [key[0]], "n": [len(digests)], "displaced": [displaced.tobytes()], "digests": [digests[by_slot].tobytes()], "locators": [locators[by_slot].tobytes()]})


def _probe(key: tuple, index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    winner = new["winner"].astype("Int64")
    known = np.zeros(len(new), bool)
    if len(index) and len(new):
        row = index.iloc[0]
        slot = probe_mph(np.frombuffer(row["displaced"], np.int64), np.frombuffer(row["digests"], np.uint64).reshape(-1, 4), _matrix(new["digest"]))
        known = slot >= 0
        winner[known] = np.frombuffer(row["locators"], np.int64)[slot[known]]
    return pd.DataFrame({"digest": new["digest"], "winner": winner, "known": known})


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(shards))


def _distinct(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest")).filter("digest is not null and id is not null")
    return own.groupBy("digest").agg(F.min("id").alias("winner"))


def build_index(history: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each shard of the history's distinct digests."""
    return _distinct(history, id_col, text_col).withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build, _INDEX)


def lookup(index: DataFrame, docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, winner, known) for each distinct digest of docs: a known winner is the history's, another the least id in docs."""
    new = _distinct(docs, id_col, text_col).withColumn("shard", _shard(shards))
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(_probe, "digest binary, winner long, known boolean")


def _winners(docs: DataFrame, id_col: str, text_col: str, history_share: float) -> DataFrame:
    """(digest, winner) over docs, whose lowest ids (history_share of their range) are the history."""
    low, high, rows = docs.agg(F.min(id_col), F.max(id_col), F.count("*")).first()
    if low is None:
        low = high = 0
    pivot = int(low) + int((int(high) - int(low)) * history_share)
    shards = max(1, -(-rows // SHARD_DIGESTS))
    old, new = docs.filter(F.col(id_col) <= pivot), docs.filter(F.col(id_col) > pivot)
    index, _ = materialize(build_index(old, shards, id_col, text_col), "mph")
    found = lookup(index, new, shards, id_col, text_col).filter("not known").select("digest", "winner")
    return index.mapInPandas(_members, "digest binary, winner long").union(found)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for digests, locators in zip(rows["digests"], rows["locators"], strict=True):
            digests = bytes(digests)
            yield pd.DataFrame({"digest": [digests[i : i + 32] for i in range(0, len(digests), 32)], "winner": np.frombuffer(locators, np.int64)})


def exact_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history_share: float = 0.5) -> DataFrame:
    """(doc_id, winner_id, is_repeat) for each row: the least id with byte-identical text wins.

    A null text equals no other, and a row without id is compared with none: such rows win
    for themselves. Empty texts are equal. Rows that share id and text have one winner, that
    id, and none is a repeat here (`drop_repeats` keeps one). A text of any length has one digest.
    Other columns are ignored. An empty table gives no rows. Only ids and 32-byte digests are shuffled.
    """
    winners = _winners(docs.select(id_col, text_col), id_col, text_col, history_share)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    winner = F.when(F.col("doc_id").isNotNull(), F.coalesce("winner", "doc_id"))
    return own.join(winners, "digest", "left").select("doc_id", winner.alias("winner_id"), F.coalesce(winner != F.col("doc_id"), F.lit(False)).alias("is_repeat"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history_share: float = 0.5) -> DataFrame:
    """docs with one row of each text: the winner's, and one of the rows that repeat its id too.

    Rows whose id or text is null stay. Of rows that share id and text any one stays. docs keeps its
    columns, whatever their names; an empty table stays empty. Texts, of any length, are shuffled once, by
    digest.
    """
    winners = _winners(docs.select(id_col, text_col), id_col, text_col, history_share)
    key, rank, won = fresh(docs, "digest", "rank", "winner")
    rows = docs.withColumn(key, F.when(F.col(id_col).isNotNull(), digest(F.col(text_col))))
    winners = winners.withColumnsRenamed({"digest": key, "winner": won})
    whole, rest = rows.filter(F.col(key).isNotNull()), rows.filter(F.col(key).isNull())
    kept = whole.join(winners, key).filter(F.col(won) == F.col(id_col))
    kept = kept.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(id_col))).filter(F.col(rank) == 1)
    return kept.select(*docs.columns).union(rest.select(*docs.columns))
