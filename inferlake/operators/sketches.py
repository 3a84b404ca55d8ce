"""A column profile from sketches that merge, for tables that are too large to shuffle every distinct value.

The number of distinct values is estimated, everything else is exact. A sketch folds within each
task, so one row per task, group and column is shuffled, whatever the columns hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferlake.operators.profile import string_columns

LOG_BUCKETS = 14          # a sketch has at most 2^14 bytes
# Merged sketches estimate with a standard error of 1.04 / sqrt(2^14) = 0.8 %; three of them.
RELATIVE_ERROR = 3 * 1.04 / 2 ** (LOG_BUCKETS / 2)
SKETCH_FIELDS = ("ordinal", "name", "n_rows", "chars", "sketch")
SKETCH_SCHEMA = "ordinal int, name string, n_rows bigint, chars bigint, sketch binary"


def column_sketches(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(``by``, ordinal, name, n_rows, chars, sketch) per group and string column; null counts as "".

    ``by`` columns are groups, such as config and split. No string column gives no row.
    """
    by = by or []
    if set(by) & set(SKETCH_FIELDS):
        raise ValueError(f"groups may not be called {', '.join(SKETCH_FIELDS)}")
    columns = [c for c in (columns if columns is not None else string_columns(df)) if c not in by]
    if not columns:
        groups = df.select(*by).where("false")
        return groups.select(*by, *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in SKETCH_SCHEMA.split(", ")))
    aggs = []
    for i, c in enumerate(columns):
        value = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        # the sketch would leave "" out, its hash it takes
        aggs += [F.hll_sketch_agg(F.xxhash64(value), LOG_BUCKETS).alias(f"_sketch{i}"),
                 F.sum(F.length(value)).alias(f"_chars{i}")]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("name"), F.col("_rows").alias("n_rows"),
                     F.col(f"_chars{i}").alias("chars"), F.col(f"_sketch{i}").alias("sketch"))
            for i, c in enumerate(columns)]
    return wide.where("_rows > 0").select(*by, F.inline(F.array(*rows)))


def merge_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of parts of a table to sketches of the whole, or of each group of it."""
    by = by or []
    return sketches.groupBy(*by, "name").agg(
        F.min("ordinal").alias("ordinal"), F.sum("n_rows").alias("n_rows"), F.sum("chars").alias("chars"),
        F.hll_union_agg("sketch").alias("sketch")).select(*by, *SKETCH_FIELDS)


def sketch_profile(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(``by``, ordinal, name, avg_len, uniq, n_rows, n_distinct): the form of ``column_profile`` and its counts.

    ``avg_len`` is exact; ``n_distinct`` is within RELATIVE_ERROR with three standard errors' certainty, and never
    above ``n_rows``.
    """
    by = by or []
    distinct = F.least(F.hll_sketch_estimate("sketch"), F.col("n_rows"))
    return merge_sketches(sketches, by).withColumn("n_distinct", distinct).select(
        *by, "ordinal", "name", F.bround(F.col("chars") / F.col("n_rows"), 1).alias("avg_len"),
        F.bround(F.col("n_distinct") / F.col("n_rows"), 2).alias("uniq"), "n_rows", "n_distinct")
