"""Integer vectors in bounded shards, and blocks of queries that visit them.

A table of vectors is ordered by some key, range-partitioned and cut into shards of at most
``SHARD_ROWS`` rows, each a few pages long. Queries are cut into blocks in the same way. A
task then takes one shard's pages into memory and lets the blocks that ask for that shard
pass by, one after the other, so its memory is one shard and one block, whatever the number of
either. Blocks of one shard are dealt over several tasks (``salt``), each with a copy of the pages.

Defined results: an id that is null, a vector that is null, and one with a null or non-finite
component take no part; vectors that are shorter than the longest count as ending in zeros; a
component that does not fit 32 bits after scaling is an error; scores are exact below 2**53.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 8_192     # rows that a task holds
LEAST_ROWS = 512       # small tables are cut finer, so that every core has a shard
BLOCK = 256            # queries that travel together
VISITS = 256           # blocks that pass by one copy of a shard
MAX_TASKS = 50_000
CHUNK_BITS = 24       # shard number: range partition above, piece below

PAGE = "shard long, seq long, ids array<long>, ints array<int>, floats array<double>"
NO_SCORE = -(2.0 ** 62)


def scaled(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))


def usable(vector: Column) -> Column:
    """No null, no infinite and no undefined component (NaN is above infinity in Spark)."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def flat(column: pa.Array, kind=None) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values if kind is None else values.astype(kind)


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """list<kind> with one item per array."""
    ends = np.cumsum([0, *(len(r) for r in rows)], dtype=np.int32)
    values = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of one integer matrix, padded with zeros."""
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    sizes, values = np.diff(ends), flat(column)
    if len(sizes) and (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int32)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(ends[:-1], sizes)] = values
    return out


def shard_count(rows: int, cores: int) -> int:
    return max(1, -(-rows // SHARD_ROWS), min(cores, -(-rows // LEAST_ROWS)))


def cores_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def chunks(df: DataFrame, order: list[str], parts: int, build: Callable, schema: str, size: int) -> DataFrame:
    """``df`` in the order of its columns ``order``, in pieces of at most ``size`` rows, each handed
    to ``build(number, batch)``, which gives record batches of ``schema``.

    Range partitions differ in size, so a task cuts what it gets; the number of a piece
    follows the order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = -1, [], 0
        for batch in batches:
            while batch.num_rows:
                if number < 0:
                    number = batch.column(0)[0].as_py() << CHUNK_BITS
                head = batch.slice(0, size - rows)
                held.append(head.select(range(1, head.num_columns)))
                rows, batch = rows + head.num_rows, batch.slice(head.num_rows)
                if rows == size:
                    yield from build(number, pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    number, held, rows = number + 1, [], 0
        if rows:
            yield from build(number, pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return placed.select(F.spark_partition_id().cast("long").alias("part"), "*").mapInArrow(run, schema)


def visit(pages: DataFrame, asks: DataFrame, open_shard: Callable, answer: Callable, schema: str,
          shards: int, blocks: int) -> DataFrame:
    """Answers of every block of ``asks`` from the shards that it asks for.

    ``pages`` and ``asks`` have the columns of ``PAGE``. ``open_shard(rows)`` turns the pages of a
    shard into what ``answer(shard, ids, ints, floats)`` searches; both work on numpy arrays.
    """
    ways = max(1, -(-blocks // VISITS))
    home = pages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))).withColumn("turn", F.lit(0))
    guests = asks.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(ways)).cast("int")).withColumn("turn", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for k, (number, salt, turn) in enumerate(keys):
                row = tuple(batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (4, 5, 6))
                if (number, salt) != key:
                    key, held, shard = (number, salt), [], None
                if turn == 0:
                    held.append(tuple(x.copy() for x in row))
                elif held or shard is not None:
                    if shard is None:
                        shard, held = open_shard(held), []
                    yield from answer(shard, *row)

    columns = ["shard", "salt", "turn", "seq", "ids", "ints", "floats"]
    tasks = max(cores_of(pages), min(MAX_TASKS, shards * ways))
    return (home.select(columns).unionByName(guests.select(columns))
            .repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "turn", "seq")
            .mapInArrow(run, schema))


def best(scores: np.ndarray, ids: np.ndarray, more_scores: np.ndarray, more_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the highest of both; ties by smaller id. The width stays that of ``scores``."""
    width = scores.shape[1]
    scores, ids = np.hstack([scores, more_scores]), np.hstack([ids, more_ids])
    order = np.lexsort((ids, -scores), axis=-1)[:, :width]
    rows = np.arange(len(order))[:, None]
    return scores[rows, order], ids[rows, order]


def sample(df: DataFrame, columns: list[str], rows: int) -> list:
    """At most ``rows`` rows, the same ones whenever they are taken."""
    return df.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(rows).collect()
