"""Fill-in-middle texts by secondary sort.

A text of n units (white space and the word after it; white space at the end is a unit, too) is cut after two
of them into prefix, middle and suffix, which change places around the marks ``<P>``, ``<S>`` and ``<M>``.
The segments travel as pieces of at most ``PIECE_UNITS`` units and ``PIECE_BYTES`` bytes, keyed by document and
output position. One exchange by document, sorted by (document, position) within its partitions
(``repartitionAndSortWithinPartitions`` of the DataFrame API), hands each output to its task piece by piece. There a running digest and the writer of
outputs take them, and the pieces go on with the place that the marks in the output give them in the original. They
are sorted once more, within the same partitions and without an exchange, and a second digest reads the restored text.
No task ever holds a text whole on that path; cutting needs the text that its input row holds.

Every input row is a document of its own, repeated ids included: pieces are keyed by the row's place in the input,
which is the same when a lost task is repeated.

Defined results: a null text is empty; an empty text has no units and is plain; a null id counts as the empty
string in the hash; a text that holds a mark is plain; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _IN_WORD as IN_WORD

PIECE_UNITS = 1_024
PIECE_BYTES = 1 << 18
BATCH_BYTES = 1 << 20
MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
RANK = {b"<P>": 0, b"<M>": 1, b"<S>": 2}     # where the text after a mark stands in the original

PIECE = "place long, at int, doc string, form string, n long, prefix_chars long, middle_chars long, body binary"
_PIECE_NAMES = ["place", "at", "doc", "form", "n", "prefix_chars", "middle_chars", "body"]
_PIECE_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def unit_ends(data: bytes) -> np.ndarray:
    """Where each unit ends, in bytes: white space is ASCII, so a byte decides."""
    if not data:
        return np.empty(0, np.int64)
    inside = IN_WORD[np.frombuffer(data, np.uint8)]
    ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    return ends if inside[-1] else np.append(ends, len(data))


def chars(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


def choose(data: bytes, n: int, h: list[int], fim_percent: int, spm_percent: int) -> str:
    if not data or any(mark in data for mark in MARKS) or h[2] % 100 >= fim_percent:
        return PLAIN
    return SPM if h[3] % 100 < spm_percent else PSM


def _cut(data: bytes, start: int, end: int, ends: np.ndarray) -> Iterator[bytes]:
    """Pieces of ``data[start:end]``: whole units, or parts of a unit beyond the limit of bytes."""
    while start < end:
        unit = int(np.searchsorted(ends, start, "right"))
        stop = int(ends[min(unit + PIECE_UNITS, len(ends)) - 1])
        if stop - start > PIECE_BYTES:
            fit = int(np.searchsorted(ends, start + PIECE_BYTES, "right"))
            stop = int(ends[fit - 1]) if fit > unit else start + PIECE_BYTES
            while fit <= unit and data[stop] & 0xC0 == 0x80:      # not within a code point
                stop -= 1
        stop = min(stop, end)
        yield data[start:stop]
        start = stop


def arrange(data: bytes, ends: np.ndarray, form: str, first: int, second: int) -> Iterator[bytes]:
    """Pieces of the output in their order, marks as pieces of their own."""
    a = int(ends[first - 1]) if first else 0
    b = int(ends[second - 1]) if second else 0
    spans = {b"<P>": (0, a), b"<M>": (a, b), b"<S>": (b, len(data))}
    if form == PLAIN:
        yield from _cut(data, 0, len(data), ends)
        return
    for mark in (b"<P>", b"<S>", b"<M>") if form == PSM else (b"<S>", b"<P>", b"<M>"):
        yield mark
        yield from _cut(data, *spans[mark], ends)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fim_percent: int = 50,
           spm_percent: int = 80, seed: int = 42) -> DataFrame:
    """(place, at, doc, form, n, prefix_chars, middle_chars, body) of every piece of every output; an empty output has one empty piece."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("place"), F.col(doc_id).cast("string").alias("doc"),
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for place, doc, data, digest in zip(*(c for c in batch.columns)):
                data, digest = data.as_py(), digest.as_py()
                h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
                ends = unit_ends(data)
                n = len(ends)
                first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                form = choose(data, n, h, fim_percent, spm_percent)
                counts = (None, None)
                if form != PLAIN:
                    a = int(ends[first - 1]) if first else 0
                    b = int(ends[second - 1]) if second else 0
                    counts = (chars(data[:a]), chars(data[a:b]))
                at = 0
                for at, body in enumerate(arrange(data, ends, form, first, second)):
                    held.append((place.as_py(), at, doc.as_py(), form, n, *counts, body))
                    size += len(body) + 64
                    if size > BATCH_BYTES:
                        yield _batch(held, _PIECE_NAMES, _PIECE_KINDS)
                        held, size = [], 0
                if not data:
                    held.append((place.as_py(), 0, doc.as_py(), form, n, *counts, b""))
                    size += 64
        if held:
            yield _batch(held, _PIECE_NAMES, _PIECE_KINDS)

    return rows.mapInArrow(run, PIECE)


def _rows(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Rows as Python values, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def in_order(cut: DataFrame, tasks: int) -> DataFrame:
    """The pieces of each document together and in output order, within partitions."""
    return cut.repartition(tasks, "place").sortWithinPartitions("place", "at")


def outputs(cut: DataFrame, tasks: int) -> DataFrame:
    """(place, at, doc, form, body): the outputs as files hold them, a piece a row, in order."""
    return in_order(cut, tasks).select("place", "at", "doc", "form", "body")


_STEP_NAMES = ["place", "rank", "at", "doc", "form", "n", "prefix_chars", "middle_chars", "body", "digest"]
_STEP_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
               pa.binary(), pa.string()]
STEP = ("place long, rank int, at int, doc string, form string, n long, prefix_chars long, middle_chars long, "
        "body binary, digest string")
CLOSING = 9     # rank of the row that ends a document; it carries the digest of the output


def _digest_outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest each output as it streams by, and give its pieces their place in the original, which the
    marks in the output tell."""
    place, digest, rank, facts, held, size = None, None, 0, (), [], 0
    for now, at, doc, form, n, prefix, middle, body in _rows(batches):
        if now != place:
            if place is not None:
                held.append((place, CLOSING, 0, *facts, None, digest.hexdigest()))
            place, digest, rank, facts = now, hashlib.sha256(), 0, (doc, form, n, prefix, middle)
        digest.update(body)
        if form != PLAIN and body in RANK:
            rank = RANK[body]
            continue
        held.append((place, rank, at, None, None, None, None, None, body, None))
        size += len(body) + 64
        if size > BATCH_BYTES:
            yield _batch(held, _STEP_NAMES, _STEP_KINDS)
            held, size = [], 0
    if place is not None:
        held.append((place, CLOSING, 0, *facts, None, digest.hexdigest()))
    if held:
        yield _batch(held, _STEP_NAMES, _STEP_KINDS)


RESULT = ("doc_id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
          "restored_sha256 string")
_RESULT_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
_RESULT_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _digest_restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, out = hashlib.sha256(), []
    for _, rank, _, doc, form, n, prefix, middle, body, output in _rows(batches):
        if rank != CLOSING:
            digest.update(body)
            continue
        out.append((doc, n, form, prefix, middle, output, digest.hexdigest()))
        digest = hashlib.sha256()
        if len(out) == 4096:
            yield _batch(out, _RESULT_NAMES, _RESULT_KINDS)
            out = []
    if out:
        yield _batch(out, _RESULT_NAMES, _RESULT_KINDS)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of
    the text that is rebuilt from it."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = in_order(pieces(docs, doc_id, text, **settings), tasks).mapInArrow(_digest_outputs, STEP)
    # a sort within partitions asks for no exchange: the document stays where it is
    found = streamed.sortWithinPartitions("place", "rank", "at").mapInArrow(_digest_restored, RESULT)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
