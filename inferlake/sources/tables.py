"""Table sources: scan, layout, counts and the row cap."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inferlake.operators.rowindex import build_index

LISTED_FILES = 10_000        # files that are named in a scan; more are found by a join
FILE_FORMATS = ("parquet", "json", "csv", "text", "orc")


def read_table(spark: SparkSession, dataset: str | DataFrame) -> DataFrame:
    """A DataFrame, a path (format from the extension, parquet for folders) or a table name."""
    if isinstance(dataset, DataFrame):
        return dataset
    extension = dataset.rstrip("/").rsplit(".", 1)[-1].lower()
    fmt = {"jsonl": "json", "txt": "text"}.get(extension, extension)
    if fmt in FILE_FORMATS:
        options = {"header": "true"} if fmt == "csv" else {}
        return spark.read.options(**options).format(fmt).load(dataset)
    if "/" in dataset:
        return spark.read.parquet(dataset)
    return spark.table(dataset)


def scan(df: DataFrame, columns: list[str], config: str | None = None,
         split: str | None = None, config_column: str = "config",
         split_column: str = "split") -> DataFrame:
    """One split of a dataset, wanted columns only. On partition columns the filters
    prune folders, otherwise they reach the file reader."""
    for column, value in ((config_column, config), (split_column, split)):
        if value is not None and column in df.columns:
            df = df.where(F.col(column) == value)
    return df.select(*columns)


def first_rows(df: DataFrame, id_column: str, n: int) -> DataFrame:
    """The first n rows in id order, as a filter on the n-th id: no task has to hold n rows,
    and a repeated id is an error for every n."""
    return build_index(df, id_column).first(df, n) if n > 0 else df.limit(0)


def with_position(df: DataFrame, columns: list[str], name: str, limit: int | None = None) -> DataFrame:
    """``columns`` of every row, with a unique id under ``name``, for sources without one.

    Rows of parquet files are known by file and place, which is also their order. Rows of any
    other DataFrame have no place of their own: equal rows are numbered, and the id is
    the row's hash and that number; a cap then takes the rows that ``limit`` returns first.
    """
    try:
        place = F.concat_ws(":", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.row_index").cast("string"), 19, "0"))
        placed = df.select(place.alias(name), *columns)
    except AnalysisException:
        rows = df.select(*columns)
        rows = rows.limit(limit) if limit else rows
        copies = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
        digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("null")) for c in columns)), 256)
        return (copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
                .select(F.concat_ws("-", digest, F.lpad(F.col("_copy").cast("string"), 19, "0")).alias(name), *columns))
    return first_rows(placed, name, limit) if limit else placed


def files_of(df: DataFrame) -> DataFrame | None:
    """(path, size, modified) of the files a table is read from, without reading a data column; None if it has none."""
    try:
        return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
                         F.col("_metadata.file_modification_time").alias("modified")).distinct()
    except AnalysisException:
        return None


def only_files(df: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of ``df`` in the files (path, ...) given; where these can be named, no other file is opened."""
    names = [r["path"] for r in files.select("path").limit(LISTED_FILES + 1).collect()]
    if len(names) <= LISTED_FILES:
        return df.where(F.col("_metadata.file_path").isin(names))
    wanted = files.select(F.col("path").alias("_path"))
    return df.withColumn("_path", F.col("_metadata.file_path")).join(wanted, "_path", "left_semi").drop("_path")


def fingerprint(df: DataFrame) -> str:
    """What tells one source without files from another: its rows."""
    hashed = df.select(F.xxhash64(*df.columns).alias("h"))
    n, total = hashed.agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).head()
    return f"{n}:{total or 0}"


def layout(df: DataFrame, config_column: str = "config", split_column: str = "split",
           order_column: str | Column | None = None) -> DataFrame:
    """(ordinal, config, split) pairs; the ordinal is the first place a pair is seen."""
    pair = [F.col(config_column).alias("config"), F.col(split_column).alias("split")]
    if order_column is None:   # partition columns alone: no data is read
        return df.select(*pair).distinct().withColumn("ordinal", F.lit(0).cast("bigint"))
    return df.groupBy(*pair).agg(F.min(order_column).alias("ordinal"))


def layout_choice(pairs: DataFrame) -> DataFrame:
    """One row (config, split, source): default/train where they exist, otherwise the
    first config and its first split; with no layout the preferred names are assumed."""
    best_split = F.min(F.struct(F.col("split") != "train", "ordinal", "split"))
    by_config = pairs.groupBy("config").agg(F.min("ordinal").alias("ordinal"),
                                            best_split.alias("s"))
    best = by_config.agg(F.min(F.struct(F.col("config") != "default", "ordinal",
                                        "config", F.col("s.split").alias("split"))).alias("b"))
    return best.select(
        F.coalesce("b.config", F.lit("default")).alias("config"),
        F.coalesce("b.split", F.lit("train")).alias("split"),
        F.when(F.col("b").isNull(), "default").otherwise("detected").alias("source"))


def row_counts(df: DataFrame, config_column: str = "config",
               split_column: str = "split") -> DataFrame:
    """Rows per split; without a filter Spark reads no data column for it."""
    return df.groupBy(F.col(config_column).alias("config"),
                      F.col(split_column).alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"))
