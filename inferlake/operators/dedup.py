"""One unit of work per distinct content, and results back on every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferlake.functions.ids import content_id

HOT_COPIES = 100_000   # copies of one content that meet under one key
MAX_HOT = 100_000      # at most this many contents are ever called hot


def distinct_contents(df: DataFrame, column: str, id_column: str) -> DataFrame:
    """(row_id, first id, n_copies) per distinct text.

    Only hashes are shuffled and copies fold on the map side, so a text that makes up
    a third of the table reaches its reducer as one row per map task.
    """
    return (df.select(content_id(F.col(column)).alias("row_id"), id_column)
            .groupBy("row_id")
            .agg(F.min(id_column).alias(id_column), F.count(F.lit(1)).alias("n_copies")))


def content_dedup(df: DataFrame, column: str, id_column: str) -> DataFrame:
    """Rows of ``df`` that are the first, by id, with their content; plus row_id, n_copies.

    The wide rows are shuffled once, on the unique id.
    """
    return df.join(distinct_contents(df, column, id_column), id_column)


def attach_to_all_rows(df: DataFrame, column: str, id_column: str, results: DataFrame,
                       copies: DataFrame, total: int,
                       hot_copies: int = HOT_COPIES, keep_salt: bool = False) -> DataFrame:
    """Every row of ``df`` with the result of its content (``results`` keyed by row_id).

    ``copies`` is (row_id, n_copies). Contents above a threshold are salted: their
    result row is repeated once for each ``threshold`` copies, and their source rows spread over
    the repeats by their own id, so about as many meet under a salted key whatever share of the table a content has.
    Of ``total`` rows at most MAX_HOT contents can pass the threshold, so the hot
    list may be broadcast. ``keep_salt`` leaves the salt in the result, to see how rows were spread.
    """
    threshold = max(hot_copies, total // MAX_HOT)
    hot = (copies.where(F.col("n_copies") > threshold)
           .select("row_id", F.ceil(F.col("n_copies") / threshold).cast("int").alias("spread")))
    keyed = (df.withColumn("row_id", content_id(F.col(column)))
             .join(F.broadcast(hot), "row_id", "left")
             .withColumn("salt", F.when(F.col("spread").isNotNull(),
                                        F.pmod(F.xxhash64(id_column), F.col("spread")))
                         .otherwise(0)).drop("spread"))
    salted = (results.join(F.broadcast(hot), "row_id", "left")
              .withColumn("salt", F.explode(
                  F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1)))
              .drop("spread"))
    joined = keyed.join(salted, ["row_id", "salt"], "left")
    return joined if keep_salt else joined.drop("salt")
