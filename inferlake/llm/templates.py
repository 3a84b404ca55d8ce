"""Dropping lines of recurring log templates, found by a fixed-depth parse tree.

A line's tokens are its words, A-Z lower-cased; tokens with a digit count as variable from the
start. The tree's levels are the number of tokens and the first ``LEADING`` tokens; a leaf holds
the lines that agree on these. Within a leaf, a token stays in the template where at least
``MIN_DOCS`` documents have it at its place; elsewhere the template has a variable field. A
template recurs if at least ``MIN_DOCS`` documents have it, and it is specific enough if its fixed tokens
are at least ``SPECIFIC`` of all. Lines of templates that are both are dropped.

All three decisions are counts of documents: of leaves, of (leaf, place, token), and of
templates. A chunk of some megabytes of text asks for each of its distinct keys once, with
its own count; the questions meet in buckets of key hashes and the totals go back. A line in a
third of all documents so counts once for each chunk. Keys are told apart by 64-bit
hashes. Lines in leaves of too few documents ask no further.

Defined results: null and empty texts have no lines and become empty; lines without a word are
kept; a document counts once, however often it has a line; equal rows and equal ids are documents of
their own; an empty table gives an empty result. Extra columns are not read.
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
from .words import Texts, mix, slices, words

LEADING = 2
MIN_DOCS = 10
SPECIFIC = 0.5
CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 20

_CHUNK = {"chunk": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.binary(), "data": pa.binary()}
_QUESTION = {"bucket": pa.int32(), "chunk": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
_ANSWER = {"round": pa.int32(), "bucket": pa.int32(), "chunk": pa.int64(), "totals": pa.binary()}
_STEP, _FIELD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to chunks."""
    part, number = TaskContext.get().partitionId(), 0
    ids: list = []
    sizes: list[np.ndarray] = []
    data: list[np.ndarray] = []

    def close():
        return batch_of([(part << 32 | number, ids, np.concatenate(sizes).astype(np.int64).tobytes(),
                          squeeze(np.concatenate(data).tobytes()))], _CHUNK)

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


class Lines:
    """Lines with a word of some texts, and what the rounds have found out about them."""

    def __init__(self, texts: Texts):
        self.texts = texts
        found = words(texts)
        breaks = np.flatnonzero(texts.data == 10)
        starts = np.concatenate([texts.offsets[:-1], breaks + 1])
        doc = np.concatenate([np.arange(len(texts)), np.searchsorted(texts.offsets, breaks, "right") - 1])
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        ends = np.append(starts[1:], 0)
        last = np.append(doc[1:] != doc[:-1], True)[:len(doc)]
        ends[last] = texts.offsets[1:][doc[last]]
        first, past = np.searchsorted(found.starts, starts), np.searchsorted(found.starts, ends)
        real = past > first
        #: Where a line begins and where the next one does.
        self.begin, self.end, self.doc = starts[real], ends[real], doc[real]
        self.first, self.count = first[real], (past - first)[real]
        digits = np.concatenate([[0], np.cumsum((texts.data >= 48) & (texts.data <= 57))])
        variable = digits[found.ends] > digits[found.starts]
        self.token = np.where(variable, _FIELD, found.hashes)
        self.variable = variable
        leaf = mix(self.count.astype(np.uint64))
        for k in range(LEADING):
            has = self.count > k
            leaf[has] = mix(leaf[has] * _STEP + self.token[self.first[has] + k])
        self.leaf = leaf
        self.open = np.arange(len(self.begin))
        self.template = np.empty(0, dtype=np.uint64)
        self.dropped = np.zeros(len(self.begin), dtype=bool)

    def _tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the open lines: the open line, the place, and the word of each token."""
        count = self.count[self.open]
        line = np.repeat(np.arange(len(self.open)), count)
        place = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
        return line, place, self.first[self.open][line] + place

    def keys(self, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a round, and the document of each, ascending."""
        if round_ == 1:
            return self.leaf, self.doc
        if round_ == 3:
            return self.template, self.doc[self.open]
        line, place, word = self._tokens()
        return (mix(mix(self.leaf[self.open][line] + place.astype(np.uint64) * _STEP) + self.token[word]),
                self.doc[self.open][line])

    def question(self, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and how many documents have them."""
        keys, doc = self.keys(round_)
        order = np.argsort(keys, kind="stable")
        keys, doc = keys[order], doc[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        return np.unique(keys[new], return_counts=True)

    def take_in(self, round_: int, totals: np.ndarray, min_docs: int) -> None:
        """Totals of the round's distinct keys in ascending order."""
        often = totals[np.unique(self.keys(round_)[0], return_inverse=True)[1]] >= min_docs
        if round_ == 1:
            self.open = self.open[often]
        elif round_ == 2:
            line, place, word = self._tokens()
            fixed = often & ~self.variable[word]
            share = np.bincount(line, fixed, len(self.open)) / self.count[self.open]
            field = np.where(fixed, self.token[word], _FIELD)
            # A sum over hashes of (place, field) tells templates of a leaf apart.
            parts = mix(field + place.astype(np.uint64) * _STEP)
            begin = np.cumsum(self.count[self.open]) - self.count[self.open]
            whole = np.add.reduceat(parts, begin) if len(parts) else parts
            enough = share >= SPECIFIC
            self.template = mix(whole + self.leaf[self.open])[enough]
            self.open = self.open[enough]
        else:
            self.dropped[self.open[often]] = True


def _meeting(chunks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    none = F.lit(None).cast("binary")
    names = ("chunk", "round", "bucket", "doc_ids", "sizes", "data", "totals")
    rows = chunks.withColumns({"round": F.lit(0), "bucket": F.lit(0), "totals": none}).select(*names)
    for a in answers:
        rows = rows.unionByName(a.withColumns(
            {"doc_ids": F.lit(None).cast("array<long>"), "sizes": none, "data": none}).select(*names))
    return rows.repartition("chunk").sortWithinPartitions("chunk", "round", "bucket") if answers else rows


def _met(batches: Iterator[pa.RecordBatch], rounds: int, min_docs: int):
    """(chunk number, ids, lines after the rounds answered so far)."""
    for (number,), rows in groups(batches, 1):
        _, _, ids, sizes, data, _ = rows[0]
        body = np.frombuffer(expand(data), np.uint8)
        lines = Lines(Texts(body, np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))]), 0))
        for k in range(1, rounds + 1):
            totals = [unpack(r[-1], np.uint64) for r in rows[1:] if r[0] == k]
            lines.take_in(k, np.concatenate(totals) if totals else np.empty(0, np.uint64), min_docs)
        yield number, ids, lines


def _ask(round_: int, bits: int, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, lines in _met(batches, round_ - 1, min_docs):
            keys, counts = lines.question(round_)
            yield batch_of([(b, number, pack_sorted(keys[s]), pack(counts[s].astype(np.uint64)))
                            for b, s in buckets(keys, bits)], _QUESTION)
    return run


def _answer(round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in groups(batches, 1):
            keys = [unpack_sorted(r[1]) for r in rows]
            used, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(used), dtype=np.uint64)
            np.add.at(total, back, np.concatenate([unpack(r[2], np.uint64) for r in rows]))
            ends = np.cumsum([len(k) for k in keys])
            yield batch_of([(round_, bucket, r[0], pack(total[back[e - len(k):e]]))
                            for r, k, e in zip(rows, keys, ends)], _ANSWER)
    return run


def _finish(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, lines in _met(batches, 3, min_docs):
            texts, rows = lines.texts, len(lines.texts)
            edge = np.zeros(len(texts.data) + 1, dtype=np.int64)
            np.add.at(edge, lines.begin[lines.dropped], 1)
            np.add.at(edge, lines.end[lines.dropped], -1)
            keep = np.cumsum(edge)[:-1] == 0
            kept = [texts.data[a:b][keep[a:b]].tobytes().decode() for a, b in zip(texts.offsets, texts.offsets[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(np.bincount(lines.doc, minlength=rows).astype(np.int64)),
                pa.array(np.bincount(lines.doc[lines.dropped], minlength=rows).astype(np.int64)),
                pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])
    return run


def drop_templates(docs: DataFrame, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept text) of every row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = staged(rows.mapInArrow(_cut, ddl(_CHUNK)), "template-chunks")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    answers: list[DataFrame] = []
    for k in (1, 2, 3):
        bits = int(size // (BUCKET_KEYS * 32)).bit_length()
        asked = _meeting(chunks, answers).mapInArrow(_ask(k, bits, min_docs), ddl(_QUESTION))
        answers.append(staged(asked.repartition("bucket").sortWithinPartitions("bucket", "chunk")
                              .mapInArrow(_answer(k), ddl(_ANSWER)), "template-answers"))
        release(docs.sparkSession)
    return _meeting(chunks, answers).mapInArrow(_finish(min_docs), "doc_id long, n_lines long, n_dropped long, kept string")
