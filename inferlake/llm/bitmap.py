"""A bitmap of hashes, of one fixed size, that rules rows out before they are shuffled.

Its size (``2**BITS`` bits, 8 MB) does not grow with the data. Rows it lets pass by chance are ruled out
by the exact join that follows; with very many keys it lets more of them pass. Python tasks ask it with
``passes``; ``among`` and ``without`` broadcast it, so that rows are neither moved nor sent to Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_name, staged

BITS = 26


def place(hashed: str | Column) -> Column:
    """The bit of a 64-bit hash: its leading bits."""
    hashed = F.col(hashed) if isinstance(hashed, str) else hashed
    return F.shiftrightunsigned(hashed, 64 - BITS)


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Set bits of a column of 64-bit hashes; at most ``2**(BITS - 6)`` rows reach the driver."""
    bit = place(column)
    rows = hashes.select(F.shiftright(bit, 6).cast("int").alias("w"),
                         F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - BITS}) & 63 as int))").alias("b"))
    found = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    words[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return words


def passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes.view(np.uint64) >> np.uint64(64 - BITS)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def _marked(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """``rows`` joined with the bitmap of ``keys``, and whether a row's ``column`` is in it; null never is."""
    bucket, bits = free_name(rows, "bucket"), free_name(rows, "bits")
    at = place(F.xxhash64(column))
    # Dealt by bucket first, so that one task alone fills a bucket's 4 KB.
    table = (keys.select(F.bitmap_bucket_number(at).alias(bucket), F.bitmap_bit_position(at).alias("bit"))
             .repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg("bit").alias(bits)))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1, F.lit(False)) & F.col(column).isNotNull()
    return rows.withColumn(bucket, F.bitmap_bucket_number(at)).join(F.broadcast(table), bucket, "left"), hit


def among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is in ``keys``, and a few others."""
    marked, hit = _marked(rows, keys, column)
    return marked.filter(hit).select(*rows.columns)


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is not in ``keys``, as a left anti join. ``keys`` is read several times.

    Values that the bitmap holds by chance are found on the column alone and make a second bitmap; only
    rows that are in both are moved.
    """
    narrow = rows.select(column)
    chance = staged(among(narrow, keys, column).join(keys, column, "left_anti").distinct(), "by-chance")
    marked, hit = _marked(rows, keys, column)
    unsure = among(among(rows, keys, column), chance, column).join(keys, column, "left_anti")
    return marked.filter(~hit).select(*rows.columns).unionByName(unsure.select(*rows.columns))
