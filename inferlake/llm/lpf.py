"""Removing repeated passages by longest-previous-factor arrays, truncated at a length.

The suffixes of all texts are ordered by their first ``length`` bytes; suffixes that agree
on these stand together, by ascending position. There, the neighbour before a suffix is its
previous smaller position in suffix order: the longest previous factor at a position reaches
``length`` exactly where that neighbour exists, and the longest next factor where the one
after it does. Bytes covered by such factors are removed: with ``keep_first`` those with an
earlier match, so that the first copy stays, otherwise those with any other match.

Only equality of prefixes matters for that, so hash ranks stand for lexicographic ones, and the
order need not be made for all positions. Three rounds narrow it down:

1. Each window of ``length`` bytes names its smallest ``SEED``-byte hash. Equal windows name
   equal seeds; neighbouring windows mostly share theirs, so a text has few.
2. Runs of windows with a seed that occurs again are compared as a whole: a run's bytes that
   occur again settle all of its windows.
3. Only the windows that are left are compared one by one.

In each round a chunk of some megabytes of text asks for each of its distinct hashes once;
questions meet in buckets of hashes, and a few bits go back. A passage in a third of all
texts so counts once for each chunk, and no group grows with the number of copies. Windows
are equal if two 64-bit hashes are: their seed's and their own.

Defined results: a null text is empty; texts shorter than ``length`` are kept; equal rows
and equal ids are texts of their own, and repeat each other; the order of positions is that
of the chunks, then of the rows in them; an empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import batch_of, buckets, ddl, expand, groups, pack, pack_sorted, squeeze, unpack, unpack_sorted
from .tables import release, staged
from .words import mix, slices, span_hashes

LENGTH = 200
SEED = 64
CHUNK_BYTES = 2 << 20
BUCKET_KEYS = 1 << 20

_CHUNK = {"chunk": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.binary(), "data": pa.binary(),
          "begins": pa.binary(), "seeds": pa.binary()}
_QUESTION = {"bucket": pa.int32(), "chunk": pa.int64(), "keys": pa.binary(), "many": pa.binary()}
_ANSWER = {"round": pa.int32(), "bucket": pa.int32(), "chunk": pa.int64(), "n": pa.int32(),
           "earlier": pa.binary(), "later": pa.binary()}


def window_seeds(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one seed: first start, last start + 1, and the seed's place."""
    seed = min(SEED, length)
    n, span = len(data) - length + 1, length - seed + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    at = np.arange(len(data) - seed + 1)
    bits = max(22, int(len(data)).bit_length())
    # A window's smallest seed, and the first of its places where it has several.
    keys = (span_hashes(data, at, at + seed) >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    pad = -len(keys) % span
    rows = np.append(keys, np.full(pad, np.uint64(2**64 - 1))).reshape(-1, span)
    up = np.minimum.accumulate(rows, axis=1).reshape(-1)
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    place = (np.minimum(down[:n], up[span - 1:span - 1 + n]) & np.uint64((1 << bits) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[:n] == text[length - 1:length - 1 + n]
    change = np.ones(n + 1, dtype=bool)
    change[1:n] = (place[1:] != place[:-1]) | (text[1:n] != text[:n - 1]) | (inside[1:] != inside[:-1])
    edges = np.flatnonzero(change)
    begin, end = edges[:-1], edges[1:]
    keep = inside[begin]
    return begin[keep], end[keep], place[begin[keep]]


def _cut(length: int):
    """Rows (doc_id, text) to chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[np.ndarray] = []
        data: list[np.ndarray] = []

        def close():
            body, counts = np.concatenate(data), np.concatenate(sizes)
            begin, end, place = window_seeds(body, np.concatenate([[0], np.cumsum(counts)]), length)
            row = (part << 32 | number, ids, counts.astype(np.int64).tobytes(), squeeze(body.tobytes()),
                   pack(np.stack([begin, end]).astype(np.uint32).reshape(-1)), pack(place.astype(np.uint32)))
            return batch_of([row], _CHUNK)

        for batch in batches:
            all_ids = batch.column(0).to_pylist()
            for texts in slices(batch.column(1)):
                ids += all_ids[texts.first_row:texts.first_row + len(texts)]
                sizes.append(np.diff(texts.offsets))
                data.append(texts.data)
                if sum(map(len, data)) >= CHUNK_BYTES:
                    yield close()
                    number += 1
                    ids, sizes, data = [], [], []
        if sizes:
            yield close()
    return run


class Chunk:
    """A chunk's bytes, and what the rounds have found out about its windows."""

    def __init__(self, sizes: bytes, data: bytes, begins: bytes, seeds: bytes, length: int):
        self.length = length
        self.sizes = np.frombuffer(sizes, np.int64)
        self.data = np.frombuffer(expand(data), np.uint8)
        self.begin, self.end = unpack(begins, np.uint32).astype(np.int64).reshape(2, -1)
        place = unpack(seeds, np.uint32).astype(np.int64)
        self.seed = span_hashes(self.data, place, place + min(SEED, length))
        #: Runs still open, and marks of window starts with an earlier or a later match.
        self.open = np.arange(len(self.begin))
        self.earlier = np.zeros(len(self.data) + 1, dtype=np.int32)
        self.later = np.zeros(len(self.data) + 1, dtype=np.int32)

    def questions(self, round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of this round with the range of window starts that each speaks for."""
        begin, end = self.begin[self.open], self.end[self.open]
        if round_ == 1:
            return self.seed[self.open], begin, end
        if round_ == 2:
            hashes = span_hashes(self.data, begin, end + self.length - 1)
            return mix(hashes ^ self.seed[self.open]), begin, end
        sizes = end - begin
        starts = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        hashes = span_hashes(self.data, starts, starts + self.length)
        return mix(hashes + np.repeat(self.seed[self.open], sizes)), starts, starts + 1

    def _mark(self, marks: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """The bytes of the windows that start in ``begin:end``."""
        np.add.at(marks, begin, 1)
        np.add.at(marks, end + self.length - 1, -1)

    def take_in(self, round_: int, earlier: np.ndarray, later: np.ndarray) -> None:
        """Answers, one for each distinct hash of the round in ascending order."""
        hashes, begin, end = self.questions(round_)
        used, back = np.unique(hashes, return_inverse=True)
        # Within the chunk, all but the first (last) of equal hashes have an earlier (later) match.
        first = np.zeros(len(hashes), dtype=bool)
        last = np.zeros(len(hashes), dtype=bool)
        first[np.unique(back, return_index=True)[1]] = True
        last[len(back) - 1 - np.unique(back[::-1], return_index=True)[1]] = True
        before, after = earlier[back] | ~first, later[back] | ~last
        if round_ == 1:
            self.open = self.open[before | after]
            return
        self._mark(self.earlier, begin[before], end[before])
        self._mark(self.later, begin[after], end[after])
        if round_ == 2:
            # A run with matches on both sides is settled; with one, its windows may have the other.
            self.open = self.open[~(before & after)]

    def removed(self, keep_first: bool) -> np.ndarray:
        marks = self.earlier if keep_first else self.earlier + self.later
        return np.cumsum(marks)[:len(self.data)] > 0


def _ask(round_: int, bits: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, _ in _met(batches, length):
            keys = np.unique(chunk.questions(round_)[0])
            yield batch_of([(b, number, pack_sorted(keys[s]), None) for b, s in buckets(keys, bits)], _QUESTION)
    return run


def _answer(round_: int):
    """In each bucket: does a hash occur in an earlier chunk, and in a later one?"""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in groups(batches, 1):
            keys = [unpack_sorted(r[1]) for r in rows]
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")  # equal hashes by ascending chunk
            same = flat[order][1:] == flat[order][:-1]
            earlier = np.zeros(len(flat), dtype=bool)
            later = np.zeros(len(flat), dtype=bool)
            earlier[order[1:][same]] = True
            later[order[:-1][same]] = True
            ends = np.cumsum([len(k) for k in keys])
            yield batch_of([(round_, bucket, r[0], len(k), np.packbits(earlier[e - len(k):e]).tobytes(),
                             np.packbits(later[e - len(k):e]).tobytes()) for r, k, e in zip(rows, keys, ends)], _ANSWER)
    return run


_MEETING = "chunk", "round", "bucket", "doc_ids", "sizes", "data", "begins", "seeds", "n", "earlier", "later"


def _meeting(chunks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    none = F.lit(None).cast("binary")
    rows = chunks.withColumns({"round": F.lit(0), "bucket": F.lit(0), "n": F.lit(0), "earlier": none, "later": none}).select(*_MEETING)
    for a in answers:
        rows = rows.unionByName(a.withColumns(
            {"doc_ids": F.lit(None).cast("array<long>"), "sizes": none, "data": none, "begins": none, "seeds": none}
        ).select(*_MEETING))
    return rows.repartition("chunk").sortWithinPartitions("chunk", "round", "bucket") if answers else rows


def _met(batches: Iterator[pa.RecordBatch], length: int):
    """(chunk number, chunk after the rounds answered so far, ids)."""
    for (number,), rows in groups(batches, 1):
        _, _, ids, sizes, data, begins, seeds, *_ = rows[0]
        chunk = Chunk(sizes, data, begins, seeds, length)
        answers: dict[int, list] = {}
        for r in rows[1:]:
            answers.setdefault(r[0], []).append(r[-3:])
        last = max(answers, default=0)
        for k in (1, 2, 3):
            bits = []
            for n, *both in answers.get(k, ()):
                bits.append([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x in both])
            if k <= last:
                none = [np.zeros(0, dtype=bool)]
                chunk.take_in(k, *(np.concatenate(x) for x in (zip(*bits) if bits else (none, none))))
        yield number, chunk, ids


def _finish(length: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, ids in _met(batches, length):
            gone = chunk.removed(keep_first)
            ends = np.cumsum(chunk.sizes)
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[ends] - sums[ends - chunk.sizes]
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            starts = (ends - chunk.sizes)[chunk.sizes > 0]
            edge[starts] = gone[starts]
            spans = np.concatenate([[0], np.cumsum(edge)])
            kept = [chunk.data[e - n:e][~gone[e - n:e]].tobytes() for n, e in zip(chunk.sizes, ends)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(chunk.sizes), pa.array(removed.astype(np.int64)),
                pa.array((spans[ends] - spans[ends - chunk.sizes]).astype(np.int64)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept bytes) of every row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = staged(rows.mapInArrow(_cut(length), ddl(_CHUNK)), "lpf-chunks")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    answers: list[DataFrame] = []
    for k in (1, 2, 3):
        # Seeds and runs are some dozen bytes apart; windows are as many as bytes, where open.
        bits = int(size // (BUCKET_KEYS * (32 if k < 3 else 4))).bit_length()
        asked = _meeting(chunks, answers).mapInArrow(_ask(k, bits, length), ddl(_QUESTION))
        answers.append(staged(asked.repartition("bucket").sortWithinPartitions("bucket", "chunk")
                              .mapInArrow(_answer(k), ddl(_ANSWER)), "lpf-answers"))
        release(docs.sparkSession)
    return _meeting(chunks, answers).mapInArrow(
        _finish(length, keep_first), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
