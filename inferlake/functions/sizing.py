"""Denominators of a run and the page resize plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected_items(limit: Column, size: Column) -> Column:
    """The smaller known value; null and 0 both mean unknown."""
    zero = F.lit(0)
    return F.least(F.nullif(limit.cast("bigint"), zero), F.nullif(size.cast("bigint"), zero))


def expected_rows(limit: Column, size: Column, batch: Column) -> Column:
    return F.ceil(expected_items(limit, size) / batch).cast("bigint")


def progress_ratio(rows_ok: Column, expected: Column) -> Column:
    """At most 1; null when the denominator is null or 0."""
    return F.when(expected != 0, F.least(F.lit(1.0), rows_ok / expected))


def resize_plan(width: Column, height: Column, target: int) -> Column:
    """struct(width, height) with the longest side at ``target``; 0 leaves the page as it is."""
    longest = F.greatest(width, height)
    keep = F.lit(target == 0) | (longest == target)
    scale = F.lit(float(target)) / longest

    def side(length: Column) -> Column:
        # half to even
        return F.when(keep, length).otherwise(F.bround(length * scale, 0).cast("int"))

    return F.struct(side(width).alias("width"), side(height).alias("height"))
