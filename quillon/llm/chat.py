"""Chat formatting by assembling tokens.

Header, content and line break of a turn are encoded separately as ordinary text, and the
reserved ids are spliced between them: no content can form a reserved id, and none is
merged with a neighbour. Strings in content that look like control tokens are escaped, so that the
decoded text doesn't show them either. The loss mask is a prefix sum of +1 where a
trained segment begins and -1 where it ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import VOCABULARY, _ids_array, _ranks

START, END, TEXT_END = "<|im_start|>", "<|im_end|>", "<|endoftext|>"
#: Reserved ids, above the vocabulary's 50,256 pieces.
RESERVED = {TEXT_END: 50256, START: 50257, END: 50258}
TRAINED = ("assistant",)
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NAMES = "|".join(re.escape(x[2:-2]) for x in RESERVED)
_CONTROL = re.compile(rf"<(\\*)\|({_NAMES})\|>")
_ESCAPED = re.compile(rf"<\\(\\*)\|({_NAMES})\|>")


def escape(text: str) -> str:
    r"""<|name|> becomes <\|name|>, and one with backslashes gets one more."""
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):  # noqa: ANN202
    import tiktoken

    return tiktoken.Encoding("chat", pat_str=_PATTERN, mergeable_ranks=_ranks(vocabulary), special_tokens={})


def _assemble(vocabulary: str, trained: tuple[str, ...]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = lru_cache(maxsize=64)(_encoder(vocabulary).encode_ordinary)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids: list[int] = []
                begins, ends, sizes = [], [], []
                for turns in part.column(1).to_pylist():
                    before = len(ids)
                    for turn in turns:
                        role = turn["role"] or ""
                        ids += [RESERVED[START], *encode(escape(role)), *encode("\n")]
                        begin = len(ids)
                        ids += [*_encoder(vocabulary).encode_ordinary(escape(turn["text"] or "")), RESERVED[END]]
                        if role in trained:
                            begins.append(begin)
                            ends.append(len(ids))
                        ids += encode("\n")
                    ids.append(RESERVED[TEXT_END])
                    sizes.append(len(ids) - before)
                change = np.bincount(begins, minlength=len(ids) + 1) - np.bincount(ends, minlength=len(ids) + 1)
                mask = np.cumsum(change)[:-1]
                size = np.array(sizes, np.int64)
                trained_tokens = np.add.reduceat(mask, np.cumsum(size) - size) if len(size) else size
                yield pa.RecordBatch.from_arrays([part.column(0), _ids_array(np.array(ids, np.int64), size), _ids_array(mask, size), pa.array(size), pa.array(trained_tokens)], ["conv_id", "input_ids", "loss_mask", "n_tokens", "n_trained"])

    return run


def format_chats(turns: DataFrame, vocabulary: str = VOCABULARY, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """(conv_id, input_ids, loss_mask, n_tokens, n_trained), one row for each conversation.

    A turn is START role newline content END newline; a conversation ends with TEXT_END.
    loss_mask is 1 for the content and END of roles in `trained`. Turns are ordered by turn
    (null first), then role, then text; turns that repeat all stay. A null role is the empty
    role and a null text the empty content; rows without conv_id are left out. A text of any length
    is encoded whole. Other columns are ignored; an empty table gives no rows.
    """
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return chats.mapInArrow(_assemble(vocabulary, trained), "conv_id long, input_ids array<int>, loss_mask array<int>, n_tokens long, n_trained long")
