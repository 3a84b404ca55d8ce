"""A profile that is kept beside a table and grows with it: files that were read once are not read again.

A store is a folder with one generation of sketches for each update that found new files:

    sketches-0000/   (config, split, column sketches) of the files of this generation
    files-0000/      path, size and time of these files, written last: without it the generation does not count

A generation is live while all its files are in the table as they were and no later generation holds one
of them. Files that no live generation holds are read and become the next generation, so a file that is gone
or was written anew costs a second read of the other files of its generation, and nothing is ever counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferlake.operators.profile import string_columns
from inferlake.operators.sketches import column_sketches, sketch_profile
from inferlake.sources import tables
from inferlake.sources.storage import exists, file_names, read_json, write_json
from inferlake.spec import SpecError


def _generations(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the complete generations, in order."""
    names = sorted(n for n in file_names(spark, store) if n.startswith("files-"))
    return [int(n.removeprefix("files-")) for n in names if exists(spark, f"{store}/{n}/_SUCCESS")]


def _path(store: str, kind: str, number: int) -> str:
    return f"{store}/{kind}-{number:04d}"


def _live(spark: SparkSession, store: str, files: DataFrame) -> tuple[list[int], DataFrame]:
    """Live generations, and the files (path, size, modified) that none of them holds."""
    numbers = _generations(spark, store)
    if not numbers:
        return [], files
    known = None
    for number in numbers:
        held = spark.read.parquet(_path(store, "files", number)).withColumn("number", F.lit(number))
        known = held if known is None else known.unionByName(held)
    newest = known.groupBy("path").agg(F.max("number").alias("newest"))
    same = ["path", "size", "modified"]
    checked = (known.join(newest, "path").join(files.withColumn("here", F.lit(True)), same, "left")
               .withColumn("good", F.col("here").isNotNull() & (F.col("number") == F.col("newest"))))
    verdicts = checked.groupBy("number").agg(F.bool_and("good").alias("live")).collect()   # a row per generation
    live = sorted(r["number"] for r in verdicts if r["live"])
    return live, files.join(known.where(F.col("number").isin(live)), same, "left_anti")


def update_profile(spark: SparkSession, df: DataFrame, store: str, columns: list[str] | None = None,
                   by: list[str] | None = None) -> int:
    """Read what the store does not know of ``df``, a table in files; the number of files that were read.

    ``by`` names the columns that tell splits apart. A store keeps the columns and splits that it was begun with.
    """
    store = store.rstrip("/")
    files = tables.files_of(df)
    if files is None:
        raise SpecError("a kept profile needs a table in files")
    by = by or []
    plan = {"by": by, "columns": columns if columns is not None else [c for c in string_columns(df) if c not in by]}
    before = read_json(spark, f"{store}/profile.json")
    if before is None:
        write_json(spark, f"{store}/profile.json", plan)
    elif before != plan:
        raise SpecError(f"{store} holds a profile of other columns or splits")
    _, new = _live(spark, store, files)
    n_new = new.count()
    if not n_new:
        return 0
    number = max((int(n.split("-")[1]) for n in file_names(spark, store) if n.startswith("files-")), default=-1) + 1
    fresh = tables.only_files(df, new)
    sketches = column_sketches(fresh, plan["columns"], by)
    sketches.write.mode("overwrite").parquet(_path(store, "sketches", number))
    new.write.mode("overwrite").parquet(_path(store, "files", number))
    return n_new


def kept_profile(spark: SparkSession, df: DataFrame, store: str, by_split: bool = False) -> DataFrame:
    """The profile of ``df`` from its store, of the whole table or of each split; no row of ``df`` is read.

    Refused while the table has files that the store does not know: ``update_profile`` reads them.
    """
    store = store.rstrip("/")
    plan = read_json(spark, f"{store}/profile.json")
    files = tables.files_of(df)
    if plan is None or files is None:
        raise SpecError(f"no profile at {store}")
    live, unknown = _live(spark, store, files)
    if unknown.head(1):
        raise SpecError(f"{store} does not know all files of the table")
    if live:
        sketches = spark.read.parquet(*(_path(store, "sketches", n) for n in live))
    else:                        # a table without rows
        sketches = column_sketches(df.where("false"), plan["columns"], plan["by"])
    return sketch_profile(sketches, plan["by"] if by_split else None)
