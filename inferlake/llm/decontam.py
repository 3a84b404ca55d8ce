"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in normal form: A-Z lower-cased, words joined by one space. An
item of n characters may differ from a passage in ``floor(rate * n)`` edits. Cut into one
piece more than that, it has a piece that the edits leave whole, wherever a passage within
the budget stands. One automaton finds all pieces of all items in one pass over a text;
runs of piece hits on neighbouring diagonals give windows, and Myers' bit-parallel
distance decides each window.

Items are handed to the tasks in blocks of about ``BLOCK_CHARS`` characters, one pass over
the documents for each block, so nothing sent to a task grows with the number of items.

An item under ``MIN_CHARS`` characters in normal form may stand in a text by chance. It has no errors to
spare and is found where it stands as whole words; ``matches`` reports it as ``weak``, and ``drop_contaminated``
keeps such documents unless told otherwise.

Defined results: null and empty texts match nothing; null and empty items match nothing; equal items are each reported; equal rows are each reported; of several
passages the one with the least distance counts, then the first; an empty table on either
side gives an empty result. Extra columns are kept by ``drop_contaminated`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .words import keep_only, tidied

RATE = 0.08
MIN_CHARS = 25
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return b" ".join((text or "").encode().lower().split()).decode()


def budget(chars: int, rate: float = RATE) -> int:
    return int(rate * chars + 1e-9)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def best_end(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and the first end of one."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, 0
    for k, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # row 0 is free: a passage may begin anywhere
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score < best:
            best, at = score, k + 1
    return best, at


class Matcher:
    """All items of a block, ready to be looked for."""

    def __init__(self, items: list[tuple[object, str]], rate: float, weak: bool = True):
        by_text: dict[str, list] = {}
        for item_id, text in items:
            by_text.setdefault(normal(text), []).append(item_id)
        self.items = [(text, ids, budget(len(text), rate) if len(text) >= MIN_CHARS else 0)
                      for text, ids in sorted(by_text.items()) if text and (weak or len(text) >= MIN_CHARS)]
        self.masks: dict[int, tuple[dict, dict]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (text, _, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                found.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def _masks(self, k: int) -> tuple[dict, dict]:
        if k not in self.masks:
            text = self.items[k][0]
            self.masks[k] = masks(text), masks(text[::-1])
        return self.masks[k]

    def find(self, text: str | None) -> list[tuple]:
        """(item id, distance, begin, end, weak) in the normal form, the best of each item."""
        if not self.items or not text:
            return []
        body = normal(text)
        diagonals: dict[int, list[int]] = {}
        short: dict[int, int] = {}
        for end, (length, places) in self.automaton.iter(body):
            begin = end + 1 - length
            for k, offset in places:
                if len(self.items[k][0]) >= MIN_CHARS:
                    diagonals.setdefault(k, []).append(begin - offset)
                elif body[begin - 1:begin] in ("", " ") and body[end + 1:end + 2] in ("", " "):
                    short.setdefault(k, begin)
        out = [(item_id, 0, begin, begin + len(self.items[k][0]), True)
               for k, begin in sorted(short.items()) for item_id in self.items[k][1]]
        for k, starts in sorted(diagonals.items()):
            item, ids, errors = self.items[k]
            best = None
            for first, last in _runs(sorted(set(starts)), 2 * errors + 1):
                begin = max(0, first - errors)
                window = body[begin:last + len(item) + errors]
                distance, at = best_end(self._masks(k)[0], len(item), window)
                if distance <= errors and (best is None or distance < best[0]):
                    back, length = best_end(self._masks(k)[1], len(item), window[:at][::-1])
                    best = distance, begin + at - length, begin + at
            if best:
                out += [(item_id, *best, False) for item_id in ids]
        return out


def _runs(sorted_numbers: list[int], gap: int) -> Iterator[tuple[int, int]]:
    first = last = None
    for x in sorted_numbers:
        if first is None:
            first = last = x
        elif x - last <= gap:
            last = x
        else:
            yield first, last
            first = last = x
    if first is not None:
        yield first, last


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks; each is small enough for the driver and the tasks."""
    items = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-chars // BLOCK_CHARS)
    for k in range(count):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).collect()]


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, begin, end, weak) of each document and each item it holds.

    Begin and end count characters of the document's normal form; ``weak`` marks short items.
    """
    out = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType),
        *(T.StructField(n, T.LongType()) for n in ("distance", "begin", "end")),
        T.StructField("weak", T.BooleanType())])
    result = docs.sparkSession.createDataFrame([], out)
    item_type = to_arrow_type(out["item_id"].dataType)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    for block in _blocks(items, item_id, item_text):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            keep_only()
            matcher = Matcher(block, rate)
            for batch in batches:
                ids, found = [], []
                for k, body in enumerate(batch.column(1)):
                    for hit in matcher.find(body.as_py()):
                        ids.append(k)
                        found.append(hit)
                if ids:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(ids)), pa.array(columns[0], item_type),
                         *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4])],
                        names=[f.name for f in out.fields])
        result = result.unionByName(source.mapInArrow(tidied(run), out))
    return result


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", rate: float = RATE, weak: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no item (with ``weak``: no short one either); every column is kept, and no
    row is moved."""
    place = docs.columns.index(text)
    for block in _blocks(items, item_id, item_text):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            keep_only()
            matcher = Matcher(block, rate, weak)
            for batch in batches:
                clean = [not matcher.find(body.as_py()) for body in batch.column(place)]
                if any(clean):
                    yield batch.filter(pa.array(clean))
        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs
