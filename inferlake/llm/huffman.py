"""Token files: canonical length-limited Huffman codes in independent blocks.

Texts are encoded, dealt into ranges of ascending id, and sorted. Global id counts give
code lengths of at most ``LIMIT`` bits (package-merge) and canonical codes. A block
holds the codes of consecutive texts as one bit string, with its bit offset at every
``STRIDE``-th token, so that decoding looks all strides of a block up in one table, in step.
A file set is two tables in one folder, ``codes`` (id, bits) and ``blocks``; it is written by
Spark's own committer, so a lost executor leaves no half block behind.

The codes have as many entries as the tokenizer has ids in use, whatever the data; so have
the counts that reach the driver.

Defined results: null and empty texts have the end id alone; equal rows and equal ids are
each written, equal ids ordered by length and ids; rows without id come first; an empty table
gives an empty file set; a single id in use gets one bit. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inferlake.session import shared_path

from .packing import pack, unpack
from .tables import release, staged
from .words import keep_only, slices, tidied
from .wordbpe import encoder

LIMIT = 18
STRIDE = 256
BLOCK_TOKENS = 1 << 19
#: Text bytes of a range of ids.
RANGE_BYTES = 24 << 20


# --- codes ---------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for symbols with positive counts."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels = []
    packages = np.empty(0, dtype=np.int64)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        place = np.argsort(merged, kind="stable")
        merged = merged[place]
        levels.append(place < n)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    lengths = np.zeros(n, dtype=np.int64)
    taken = 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:taken].sum())
        lengths[:own] += 1  # the lightest leaves are taken first
        taken = 2 * (taken - own)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Codes:
    """Canonical codes: shorter first, then by id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.uint32), bits[order].astype(np.int64)
        self.width = int(self.bits.max()) if len(ids) else 1
        # As fractions of the widest code, codes are running sums of 2**(width - bits).
        span = np.left_shift(1, self.width - self.bits)
        first = np.cumsum(span) - span
        self.codes = first >> (self.width - self.bits)
        size = int(self.ids.max()) + 1 if len(ids) else 0
        self.code_of = np.zeros(size, dtype=np.uint64)
        self.bits_of = np.zeros(size, dtype=np.int64)
        self.code_of[self.ids], self.bits_of[self.ids] = self.codes.astype(np.uint64), self.bits
        self.symbol = np.zeros(1 << self.width, dtype=np.uint32)
        self.length = np.ones(1 << self.width, dtype=np.int64)
        filled = int(span.sum())
        self.symbol[:filled] = np.repeat(self.ids, span)
        self.length[:filled] = np.repeat(self.bits, span)

    def encode(self, tokens: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string, and its bit offset at every ``STRIDE``-th token."""
        bits = self.bits_of[tokens]
        ends = np.cumsum(bits)
        starts = ends - bits
        value = self.code_of[tokens] << (64 - bits - (starts & 31)).astype(np.uint64)
        size = (int(ends[-1]) if len(ends) else 0) // 32 + 2
        word = starts >> 5
        # Bits of different codes never overlap, so sums of 32-bit parts are exact in doubles.
        packed = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size)
        packed += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
        return packed.astype(np.uint32).astype(">u4").tobytes(), starts[::STRIDE]

    def decode(self, payload: bytes, offsets: np.ndarray, count: int) -> np.ndarray:
        if not count:
            return np.empty(0, dtype=np.uint32)
        packed = np.frombuffer(payload, ">u4").astype(np.uint64)
        pairs = np.append(packed[:-1] << np.uint64(32) | packed[1:], packed[-1] << np.uint64(32))
        at = offsets.astype(np.int64).copy()
        out = np.empty((STRIDE, len(at)), dtype=np.uint32)
        last, mask = len(pairs) - 1, np.uint64((1 << self.width) - 1)
        for k in range(min(STRIDE, count)):
            window = pairs[np.minimum(at >> 5, last)] >> (64 - self.width - (at & 31)).astype(np.uint64)
            index = (window & mask).astype(np.int64)
            out[k] = self.symbol[index]
            at += self.length[index]
        return out.T.reshape(-1)[:count]


# --- tables --------------------------------------------------------------------------------

def tokenized(docs: DataFrame, tokenizer: str, end: int | None, doc_id: str, text: str) -> DataFrame:
    """(part, place, doc_id, before, n, ids) in ascending id order: ``part`` is a range of ids,
    ``place`` a row's number in it, and ``before`` counts the ids of the rows before it there."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    parts = max(1, -(-size // RANGE_BYTES))
    cuts = docs.agg(F.percentile_approx(doc_id, [k / parts for k in range(1, parts)], F.lit(100 * parts))
                    .alias("c")).first()["c"] if parts > 1 else []
    cuts = np.array(cuts or [], dtype=np.int64)
    kind = docs.schema[doc_id].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        for batch in batches:
            for texts in slices(batch.column(1)):
                flat, counts = made.encode(texts, end)
                ends = np.cumsum(counts)
                ids = batch.column(0).slice(texts.first_row, len(texts))
                keys = np.array([-(1 << 63) if x is None else x for x in ids.to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.searchsorted(cuts, keys, "left").astype(np.int32)), ids, pa.array(counts),
                    pa.array([pack(flat[e - c:e]) for e, c in zip(ends.tolist(), counts.tolist())], pa.binary())],
                    names=["part", "doc_id", "n", "ids"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = place = before = None
        for batch in batches:
            places, befores = [], []
            for p, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if p != part:
                    part, place, before = p, 0, 0
                places.append(place)
                befores.append(before)
                place += 1
                before += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(places, pa.int64()), batch.column(1), pa.array(befores, pa.int64()),
                 *batch.columns[2:]], names=["part", "place", "doc_id", "before", "n", "ids"])

    first = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", kind),
                          T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    then = T.StructType([first["part"], T.StructField("place", T.LongType()), first["doc_id"],
                         T.StructField("before", T.LongType()), first["n"], first["ids"]])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(encode), first)
    return (rows.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "n", "ids")
            .mapInArrow(tidied(number), then))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_only()
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for data in (x.as_py() for x in batch.column(0)):
            if data:
                own = np.bincount(unpack(data, np.uint32))
                if len(own) > len(total):
                    total = np.append(total, np.zeros(len(own) - len(total), dtype=np.int64))
                total[:len(own)] += own
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


BLOCKS = ("part int, place long, start long, doc_ids array<long>, sizes array<long>, "
          "offsets binary, payload binary")
_BLOCK_NAMES = ("part", "place", "start", "doc_ids", "sizes", "offsets", "payload")
_BLOCK_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None = None,
          doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the token files of ``docs`` to the folder ``path``."""
    spark = docs.sparkSession
    rows = staged(tokenized(docs, tokenizer, end, doc_id, text), "token-ids")
    release(spark)
    counts = rows.select("ids").mapInArrow(tidied(_count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts.sort()
    bits = code_lengths(np.array([r["n"] for r in counts], dtype=np.int64))
    spark.createDataFrame([(r["id"], int(b)) for r, b in zip(counts, bits)], "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    codes = Codes(np.array([r["id"] for r in counts], dtype=np.int64), bits)
    # One row for each range of ids.
    totals = rows.groupBy("part").agg(F.sum("n").alias("n"))
    starts = staged(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first")),
                    "token-starts")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        held: list[tuple] = []
        size = 0

        def close():
            tokens = np.concatenate([unpack(r[4], np.uint32) for r in held])
            payload, offsets = codes.encode(tokens)
            row = (held[0][0], held[0][1], held[0][5] + held[0][3], [r[2] for r in held],
                   [r[6] for r in held], offsets.astype("<i8").tobytes(), payload)
            return pa.RecordBatch.from_arrays(
                [pa.array([value], kind) for value, kind in zip(row, _BLOCK_TYPES)], names=list(_BLOCK_NAMES))

        for batch in batches:
            for row in (tuple(c[k].as_py() for c in batch.columns) for k in range(batch.num_rows)):
                if held and (row[0] != held[0][0] or row[1] != held[-1][1] + 1 or size >= BLOCK_TOKENS):
                    yield close()
                    held, size = [], 0
                held.append(row)
                size += row[6]
        if held:
            yield close()

    (rows.join(starts, "part").select("part", "place", "doc_id", "before", "ids", "first", "n")
     .mapInArrow(tidied(encode), BLOCKS).write.parquet(f"{path}/blocks"))


def _codes(spark: SparkSession, path: str) -> Codes:
    entries = spark.read.parquet(f"{path}/codes").collect()
    return Codes(np.array([r["id"] for r in entries], dtype=np.int64), np.array([r["bits"] for r in entries], dtype=np.int64))


def _decoded(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of the rows, first token of each, end of each in the block's tokens, tokens), a block at a time."""
    keep_only()
    for batch in batches:
        for k in range(batch.num_rows):
            start, doc_ids, sizes, offsets, payload = (c[k] for c in batch.columns)
            sizes = sizes.values.to_numpy()
            tokens = codes.decode(payload.as_buffer(), np.frombuffer(offsets.as_buffer(), "<i8"), int(sizes.sum()))
            ends = np.cumsum(sizes)
            yield doc_ids.values, start.as_py() + ends - sizes, ends, tokens.astype("<u4")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("start", "doc_ids", "sizes", "offsets", "payload")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids as little-endian 32-bit numbers) of a folder's token files."""
    codes = _codes(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, starts, ends, tokens in _decoded(batches, codes):
            parts = [x.tobytes() for x in np.split(tokens, ends[:-1])]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(parts, pa.binary())],
                                             names=["doc_id", "start", "ids"])

    return _blocks(spark, path).mapInArrow(tidied(run), "doc_id long, start long, ids binary")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a folder's token files; the ids themselves stay in the task that decodes them."""
    codes = _codes(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, starts, ends, tokens in _decoded(batches, codes):
            parts = np.split(tokens, ends[:-1])
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(starts), pa.array([len(x) for x in parts], pa.int64()),
                 pa.array([zlib.crc32(x) for x in parts], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _blocks(spark, path).mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, tokenizer: str, end: int | None) -> DataFrame:
    """Write token files to the shared folder, read them back, and digest every text's ids."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-files")
    write(docs, path, tokenizer, end)
    release(spark)
    return read_digests(spark, path)
