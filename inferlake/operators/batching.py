"""Micro-batches of consecutive rows, and the way back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferlake.functions.ids import batch_id
from inferlake.operators.rowindex import RowIndex, build_index


def micro_batch(rows: DataFrame, id_column: str, text_column: str, batch: int,
                index: RowIndex | None = None) -> DataFrame:
    """(batch_no, row_id, member_ids, texts): ``batch`` neighbours in id order, short tail kept.

    Slices hold whole batches, so grouping by (slice, batch) reuses the slice
    partitioning: the texts cross the network once.
    """
    index = index or build_index(rows, id_column, align=batch)
    if index.chunk % batch:
        raise ValueError(f"index slices of {index.chunk} rows do not hold whole batches")
    numbered = index.attach(rows.select(id_column, text_column))
    member = F.struct(F.col("idx"), F.col(id_column).alias("id"),
                      F.col(text_column).alias("text"))
    return (numbered
            .groupBy("slice_no", F.expr(f"idx div {batch}").alias("batch_no"))
            .agg(F.array_sort(F.collect_list(member)).alias("members"))  # <= batch members
            .select("batch_no",
                    batch_id(F.get("members", 0)["id"]).alias("row_id"),
                    F.transform("members", lambda m: m["id"]).alias("member_ids"),
                    F.transform("members", lambda m: m["text"]).alias("texts")))


def explode_batches(units: DataFrame, *arrays: str) -> DataFrame:
    """One row per batch member: (row_id, member_id, and one item of each array)."""
    named = [F.col("member_ids").alias("member_id"), *[F.col(a) for a in arrays]]
    zipped = F.arrays_zip(*named)
    return (units.select("row_id", F.inline(zipped)))
