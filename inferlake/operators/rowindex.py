"""Dense row numbers in id order without a single-partition window.

A first pass range-partitions the ids alone and stages them with their exact
numbers. From that table come the first ids of equal slices of the rows, and with
those any later scan knows the slice of a row by a binary search for its id: wide columns are
scanned and shuffled once, each slice to the partition of its own number, whatever the spread of
the ids. A slice holds exactly ``chunk`` rows, so its offset is known and a row's number is the
offset plus its place in the sorted partition. (Range-partitioning the wide rows themselves
would scan them twice, as Spark samples the whole rows first.)
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from inferlake.session import stage

SLICE_ROWS = 500_000     # rows of one slice, while the number of slices allows it
MAX_SLICES = 65_536      # bounds what the driver collects and each task carries
_POSITION_BITS = 33      # monotonically_increasing_id: partition above, row below


class DuplicateIdError(ValueError):
    pass


def _constant(values: list, dtype: str) -> Column:
    """One foldable literal instead of one expression node per value."""
    return F.from_json(F.lit(json.dumps(values)), dtype)


@dataclass
class RowIndex:
    table: DataFrame        # (id, idx), every row once
    id_column: str
    id_type: DataType
    total: int
    chunk: int              # rows per slice
    starts: list[str]       # first id of slice 1, 2, ..., as text

    @property
    def slices(self) -> int:
        return len(self.starts) + 1

    def slice_of(self, row_id: Column) -> Column:
        """Number of slice starts at or below the id: at most 17 steps of a binary search."""
        if not self.starts:
            return F.lit(0)
        starts = _constant(self.starts, "array<string>").cast(f"array<{self.id_type.simpleString()}>")
        steps = [1 << k for k in reversed(range(len(self.starts).bit_length()))]
        # F.get gives null beyond the end, and a step that is not known to fit is not taken
        return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda found, step: F.when(
            F.get(starts, found + step - 1) <= row_id, found + step).otherwise(found))

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` plus (slice_no, idx), partitioned by slice and sorted by id. ``df`` must hold the ids the
        index was built on."""
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
        return (df.withColumn("slice_no", self.slice_of(F.col(self.id_column)))
                .repartitionById(self.slices, "slice_no")
                .sortWithinPartitions(self.id_column)
                .withColumn("idx", F.col("slice_no").cast("bigint") * self.chunk + place))

    def first(self, df: DataFrame, n: int) -> DataFrame:
        """The first n rows as a plain filter on the id, which the scan can push down."""
        if n >= self.total:
            return df
        bound = self.table.where(F.col("idx") == n - 1).select(
            F.col(self.id_column).cast("string")).head()
        return df.where(F.col(self.id_column) <= F.lit(bound[0]).cast(self.id_type))


def build_index(df: DataFrame, id_column: str, align: int = 1,
                slice_rows: int = SLICE_ROWS) -> RowIndex:
    """Number the rows of ``df`` by a unique ``id_column``; slices hold a multiple of ``align``.

    ``df`` must read the same rows each time (a table snapshot or closed files).
    """
    # Range partitioning reads its input twice (sample, then shuffle), so the ids are
    # staged before it; it brings equal ids together, so the count adds no shuffle.
    source_ids = stage(df.select(id_column), "source-ids")
    ranges = min(MAX_SLICES, math.ceil(source_ids.count() / slice_rows) or 1)
    ranged = (source_ids
              .repartitionByRange(ranges, id_column)
              .groupBy(id_column).agg(F.count(F.lit(1)).alias("copies"))
              .sortWithinPartitions(id_column)
              .withColumn("pos", F.monotonically_increasing_id()))
    staged = stage(ranged, "ids")

    source = F.shiftright("pos", _POSITION_BITS)
    counts = (staged.groupBy(source.alias("part"))
              .agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("copies"),
                   F.count_if(F.col(id_column).isNull()).alias("nulls"))
              .collect())                       # one row per range partition
    if any(r["copies"] > 1 or r["nulls"] for r in counts):
        raise DuplicateIdError(f"{id_column!r} must be unique and not null")
    sizes = [0] * (max((r["part"] for r in counts), default=-1) + 1)
    for r in counts:
        sizes[r["part"]] = r["n"]
    offsets = [0, *accumulate(sizes)]
    total = offsets[-1]

    offset = F.get(_constant(offsets, "array<bigint>"), source.cast("int"))
    position = F.col("pos").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    table = staged.select(id_column, (offset + position).alias("idx"))

    # a slice is one task of ``attach``; small tables still keep every core busy
    cores = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = min(MAX_SLICES, max(cores, ranges))
    chunk = max(1, math.ceil(math.ceil(total / slices) / align)) * align
    firsts = (table.where((F.col("idx") % chunk == 0) & (F.col("idx") > 0))
              .select("idx", F.col(id_column).cast("string"))
              .collect())                       # at most MAX_SLICES - 1 rows
    starts = [first for _, first in sorted(map(tuple, firsts))]
    return RowIndex(table, id_column, df.schema[id_column].dataType, total, chunk, starts)
