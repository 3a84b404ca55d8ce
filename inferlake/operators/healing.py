"""The healing read: a good record replaces earlier errors of the same id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inferlake.session import stage


def _preference(attempt: str, error: str):
    return [F.col(error).isNotNull(), F.col(attempt).desc()]


def healed(df: DataFrame, id_column: str = "row_id", attempt: str = "attempt",
           error: str = "error", include_errors: bool = False) -> DataFrame:
    """One record per id: error-free first, then the latest attempt.

    The rank filter is applied before the shuffle too (window group limit), so an id
    tried very often does not travel whole to one task.
    """
    pick = Window.partitionBy(id_column).orderBy(*_preference(attempt, error))
    best = df.withColumn("_pick", F.row_number().over(pick)).where("_pick = 1").drop("_pick")
    return best if include_errors else best.where(F.col(error).isNull())


def healed_files(records: DataFrame, include_errors: bool = False) -> DataFrame:
    """The same rule over part files whose sidecars are missing or of an older form.

    Narrow columns are folded per id, on the map side first; only ids with several
    records have losers, and those positions are removed from the scan by an anti-join.
    """
    at = records.select(
        "row_id", F.col("error").isNotNull().alias("failed"), (-F.col("attempt")).alias("age"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    best = (at.groupBy("row_id")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.min(F.struct("failed", "age", "_file", "_row")).alias("best"))
            .where("n > 1").select("row_id", "best"))
    losers = (at.join(best, "row_id")
              .where((F.col("_file") != F.col("best._file"))
                     | (F.col("_row") != F.col("best._row")))
              .select("_file", "_row"))
    data = records if include_errors else records.where(F.col("error").isNull())
    return (data.withColumn("_file", F.col("_metadata.file_path"))
            .withColumn("_row", F.col("_metadata.row_index"))
            .join(losers, ["_file", "_row"], "left_anti").drop("_file", "_row"))


VECTOR_BYTES = 32 << 20   # deletion vectors that travel to the tasks at once
_BITMAP_BYTES = 4_096     # of one bitmap: 32,768 positions


def losing_positions(ids: DataFrame, include_errors: bool = False) -> DataFrame:
    """(file, pos) of the records in ``ids`` (row_id, ok, attempt, file, pos) that another one of their id replaces.

    Without errors only good records are compared, as a failed one is dropped by its own error.
    """
    rows = ids if include_errors else ids.where("ok")
    best = Window.partitionBy("row_id").orderBy(F.col("ok").desc(), F.col("attempt").desc(), "file", "pos")
    return rows.withColumn("_nth", F.row_number().over(best)).where("_nth > 1").select("file", "pos")


def deletion_vectors(positions: DataFrame) -> DataFrame:
    """(file, bucket, dead): one bit for each position of a file that is not to be read."""
    at = F.col("pos") + 1     # bitmap buckets count from one
    return positions.groupBy("file", F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("dead"))


def without_dead(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """``records`` of part files but the positions in ``vectors``, which must be small enough to broadcast."""
    at = F.col("_metadata.row_index") + 1
    placed = (records.withColumn("_file", F.col("_metadata.file_name"))
              .withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_bit", F.bitmap_bit_position(at).cast("int")))
    marks = vectors.select(F.col("file").alias("_file"), F.col("bucket").alias("_bucket"), "dead")
    byte = F.expr("cast(conv(hex(substring(dead, _bit div 8 + 1, 1)), 16, 10) as int)")
    return (placed.join(F.broadcast(marks), ["_file", "_bucket"], "left")
            .where(F.col("dead").isNull() | (F.getbit(byte, F.col("_bit") % 8) == 0))
            .drop("_file", "_bucket", "_bit", "dead"))


def healed_parts(spark, root: str, names: list[str], shared: set[str], include_errors: bool = False) -> DataFrame:
    """One record per id of committed parts, through deletion vectors.

    ``shared`` are parts that may hold an id that another record holds too. Their sidecars tell which
    positions lose; the bitmaps of a file's positions go to the tasks that read that file, as many files at a time
    as VECTOR_BYTES allow, and no payload is shuffled whatever the number of losers. Every other file is
    read without a join.
    """
    whole = spark.read.parquet(*(f"{root}/{n}" for n in names))
    kept = whole if include_errors else whole.where(F.col("error").isNull())
    if not shared:
        return kept
    sidecars = spark.read.parquet(*(f"{root}/_manifest/ids-{n}" for n in sorted(shared)))
    if not {"file", "pos"} <= set(sidecars.columns):     # sidecars of an older form
        return healed_files(whole, include_errors)
    vectors = stage(deletion_vectors(losing_positions(sidecars, include_errors)), "deletion-vectors")
    sizes = vectors.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect()   # a row per file
    if not sizes:
        return kept
    packs, room = [], 0
    for r in sizes:
        if not packs or room < r["n"]:
            packs.append([])
            room = max(VECTOR_BYTES // _BITMAP_BYTES, r["n"])
        packs[-1].append(r["file"])
        room -= r["n"]
    name = F.col("_metadata.file_name")
    result = kept.where(~name.isin([r["file"] for r in sizes]))
    for files in packs:
        result = result.unionByName(without_dead(kept.where(name.isin(files)), vectors.where(F.col("file").isin(files))))
    return result
