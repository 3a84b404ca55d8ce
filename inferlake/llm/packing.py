"""Numbers in compact binary columns, and rows that meet by key inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import tidy


def squeeze(data: bytes | memoryview) -> bytes:
    """Bytes compressed, after their number."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: the high planes of small numbers take no room."""
    width = numbers.dtype.itemsize
    return squeeze(np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, width).T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(expand(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def buckets(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Sorted keys by their leading bits."""
    number = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(keys)]):
        yield int(number[a]), slice(int(a), int(b))


def batch_of(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def ddl(kinds: dict) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string",
             pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"`{k}` {names[t]}" for k, t in kinds.items())


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows that follow each other with equal first ``width`` columns."""
    key, held = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            row = [c[k].as_py() for c in batch.columns]
            if tuple(row[:width]) != key:
                if held:
                    yield key, held
                key, held = tuple(row[:width]), []
            held.append(row[width:])
    if held:
        yield key, held
    tidy()
