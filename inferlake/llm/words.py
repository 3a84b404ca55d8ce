"""Words, shingles and hashes of whole texts, computed on Arrow columns with numpy.

Every function works inside one task on slices of a few megabytes of text, so a
task's memory depends on its longest single text, not on its number of rows.
A word is a run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return; a null text has no words.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SHINGLE = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def process_cache() -> dict:
    """What a Python process keeps from one task to the next.

    Functions of this package travel to the executors by value, each time with globals of
    their own; only a module of the process outlives a task.
    """
    return sys.modules.setdefault("inferlake_llm_cache", ModuleType("inferlake_llm_cache")).__dict__


#: What any operator may keep: the powers for hashes.
SHARED = ("up", "down")


def keep_only(*names: str) -> None:
    """Drop what tasks of other operators have left in this process, which its next task would carry along.

    Every task that holds much, or keeps something, says so first: an executor's memory is
    then that of the operators at work, whatever has run before.
    """
    cache = process_cache()
    gone = [n for n in cache if not n.startswith("__") and n not in SHARED and n not in names]
    for name in gone:
        del cache[name]
    if gone:
        gc.collect()
        tidy()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2**64."""
    cache = process_cache()
    if len(cache.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for name, factor in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            cache[name] = np.cumprod(steps)
    return cache["up"], cache["down"]


def tidy() -> None:
    """Give memory that numpy and Arrow have freed back to the system: idle workers share an
    executor's memory with the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidied(step):
    """``step`` (batches to batches), whose process gives its freed memory back when the task ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        tidy()   # after the step's own variables are gone
    return run


@dataclass
class Texts:
    """Bytes of some texts, end to end; text ``i`` is ``data[offsets[i]:offsets[i+1]]``."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into slices of about ``size`` bytes, never within a text."""
    for chunk in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]):
        chunk = pc.fill_null(chunk, "" if not pa.types.is_binary(chunk.type) else b"")
        kind = pa.large_binary() if pa.types.is_binary(chunk.type) else pa.large_string()
        chunk = chunk.cast(kind)
        _, raw, body = chunk.buffers()
        rows = len(chunk)
        if rows == 0:
            continue
        offsets = np.frombuffer(raw, np.int64, rows + 1, chunk.offset * 8)
        data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
        row = 0
        while row < rows:
            end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
            end = min(max(end, row + 1), rows)
            yield Texts(data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row], row)
            row = end
    tidy()


@dataclass
class Words:
    """The words of a slice: byte positions, number per text, and 64-bit hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The slice row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``data[start:end]`` for each span; equal bytes, equal hash."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: Texts, lower: bool = True) -> Words:
    data = _LOWER[texts.data] if lower else texts.data
    inside = _IN_WORD[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    first = texts.offsets[:-1]
    before[first[first < len(data)]] = False
    last = texts.offsets[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, texts.offsets))
    return Words(data, starts, ends, counts, span_hashes(data, starts, ends))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` neighbouring hashes (texts are not told apart)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _STEP
        out += hashes[k:n + k]
    return mix(out)


@dataclass
class Shingles:
    """Distinct shingle hashes of each text, ascending; ``counts`` per text."""

    hashes: np.ndarray
    counts: np.ndarray


def shingles(found: Words, width: int = SHINGLE) -> Shingles:
    """Distinct runs of ``width`` words; the whole text where it has fewer words."""
    rows = len(found.counts)
    whole = window_hashes(found.hashes, width)
    text = found.text
    same = text[:len(whole)] == text[width - 1:width - 1 + len(whole)] if len(whole) else np.empty(0, bool)
    values, owner = whole[same], text[:len(whole)][same]
    short = np.flatnonzero((found.counts > 0) & (found.counts < width))
    if len(short):
        begin = np.cumsum(found.counts) - found.counts
        own = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            has = found.counts[short] > k
            own[has] = own[has] * _STEP + found.hashes[begin[short[has]] + k]
        values = np.concatenate([values, mix(own + found.counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.argsort(values)
    order = order[np.argsort(owner[order].astype(np.uint16 if rows < 65536 else np.int64), kind="stable")]
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return Shingles(values[keep], np.bincount(owner[keep], minlength=rows))
