"""Integer codecs: variable-length bytes, bit packing in blocks of 128, deltas.

Storage leaves these to Parquet; they are here for data exchanged in these forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 128


def varint_encode(values: np.ndarray) -> bytes:
    """Groups of 7 bits, least first, the top bit set while more follow."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return b""
    size = varint_sizes(v)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]), np.uint8)
    for k in range(5):
        own = slice(None) if k == 0 else np.flatnonzero(size > k)
        out[(ends - size)[own] + k] = (v[own] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | (size[own] > k + 1).astype(np.uint8) << 7
    return out.tobytes()


def varint_decode(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    if not len(raw):
        return np.zeros(0, np.uint64)
    if raw[-1] & 128:
        raise ValueError("the last number is cut off")
    last = raw < 128
    start = np.flatnonzero(np.append(True, last[:-1]))
    size = np.diff(np.append(start, len(raw)))
    if size.max() > 5:
        raise ValueError("a number has more than 5 bytes")
    place = np.arange(len(raw)) - np.repeat(start, size)
    return np.add.reduceat((raw & np.uint64(127)) << (place.astype(np.uint64) * np.uint64(7)), start)


def required_bits(values: np.ndarray) -> int:
    return int(np.max(values, initial=0)).bit_length()


def pack(values: np.ndarray, width: int) -> bytes:
    """A block of 128 numbers in `width` bits each (0 to 32), least bit first."""
    v = np.asarray(values, np.uint64)
    if len(v) != BLOCK or not 0 <= width <= 32:
        raise ValueError("a block has 128 numbers of at most 32 bits")
    bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    if not width:
        return np.zeros(BLOCK, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: BLOCK * width].reshape(BLOCK, width)
    return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))


def varint_sizes(values: np.ndarray) -> np.ndarray:
    """Bytes that each number takes."""
    return 1 + sum((np.asarray(values, np.uint64) >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 5))


def varint_rows(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Binaries, the k-th of values[first[k] : first[k + 1]]."""
    ends = np.append(0, np.cumsum(varint_sizes(values)))[first].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(varint_encode(values))]).cast(pa.binary())


def varint_flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What varint_rows was given."""
    data = column.cast(pa.large_binary())
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return varint_decode(raw.tobytes()).astype(np.int64), np.append(0, np.cumsum(raw < 128))[at - at[0]]


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column and where each row's begin; null rows have none."""
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))


@F.arrow_udf(T.BinaryType())
def varint_bytes(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """All numbers of a batch at once."""
    for part in parts:
        values, first = _numbers(part)
        ends = np.append(0, np.cumsum(varint_sizes(values)))[first]
        none = None if not part.null_count else pa.py_buffer(np.packbits(part.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
        yield pa.Array.from_buffers(pa.binary(), len(part), [none, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(varint_encode(values))])


@F.arrow_udf(T.ArrayType(T.LongType()))
def varint_numbers(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        data = part.fill_null(b"").cast(pa.large_binary())
        at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        if any(raw[e - 1] & 128 for e in (at[1:] - at[0])[np.diff(at) > 0].tolist()):
            raise ValueError("the last number is cut off")
        first = np.append(0, np.cumsum(raw < 128))[at - at[0]]
        yield pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(varint_decode(raw.tobytes()).astype(np.int64)), mask=part.is_null() if part.null_count else None)


@F.arrow_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("packed", T.BinaryType()), T.StructField("same", T.BooleanType())]))
def packed_blocks(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Blocks of up to 128 numbers, filled with zeros: their bits a number, packed, and whether they unpack to the same."""
    for part in parts:
        values, first = _numbers(part)
        size = np.diff(first)
        if size.max(initial=0) > BLOCK:
            raise ValueError("a block has 128 numbers")
        rows = np.zeros((len(part), BLOCK), np.uint64)
        rows[np.repeat(np.arange(len(part)), size), np.arange(len(values)) - np.repeat(first[:-1], size)] = values
        widths = [required_bits(r) for r in rows]
        packed = [pack(r, w) for r, w in zip(rows, widths, strict=True)]
        same = [bool((unpack(b, w) == r).all()) for b, r, w in zip(packed, rows, widths, strict=True)]
        yield pa.StructArray.from_arrays([pa.array(widths, pa.int32()), pa.array(packed, pa.binary()), pa.array(same, pa.bool_())], ["width", "packed", "same"])


def bit_width(most: Column) -> Column:
    """Bits that hold every number up to `most`."""
    return F.when(most <= 0, 0).otherwise(F.length(F.bin(most.cast("long")))).cast("int")


def delta(value: Column, *by: str) -> Column:
    """Difference from the one before in each group of `by`, the first from 0."""
    return value - F.lag(value, 1, 0).over(Window.partitionBy(*by).orderBy(value))
