"""From a source table to work units: (row_id, rank, wave, request columns).

A wave is a run of neighbouring units that is committed together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferlake.functions.ids import shard_rank
from inferlake.functions.text import clean_text
from inferlake.operators.batching import micro_batch
from inferlake.operators.dedup import distinct_contents
from inferlake.operators.rowindex import build_index
from inferlake.session import stage
from inferlake.sources.pages import list_pages
from inferlake.sources.tables import first_rows, with_position
from inferlake.spec import JobSpec


def _wave(index: str, units: int):
    return F.expr(f"{index} div {units}").alias("wave")


POSITION = "_position"


def _capped(df: DataFrame, spec: JobSpec) -> tuple[DataFrame, str]:
    """(id, text) of the first ``limit`` rows in id order, and the id's name. The cap counts
    input rows, before empty ones are dropped; every copy is a row of its own."""
    if spec.id_column is None:
        # Staged, as a hash and number or a place must mean the same row in every later scan.
        return stage(with_position(df, [spec.column], POSITION, spec.limit), "positions"), POSITION
    rows = df.select(spec.id_column, spec.column)
    return (first_rows(rows, spec.id_column, spec.limit) if spec.limit else rows), spec.id_column


def embedding_work(df: DataFrame, spec: JobSpec, wave_units: int) -> DataFrame:
    """Batches of cleaned texts."""
    rows, id_column = _capped(df, spec)
    units = micro_batch(clean_text(rows, spec.column, spec.truncate), id_column, spec.column, spec.batch)
    return units.select("row_id", shard_rank(F.col("batch_no"), spec.world).alias("rank"),
                        _wave("batch_no", wave_units),
                        F.lit(1).cast("bigint").alias("n_copies"), "member_ids", "texts")


def generation_work(df: DataFrame, spec: JobSpec, wave_units: int) -> DataFrame:
    """One prompt per distinct content, ranked by the first row that holds it.

    Hashes and ids meet first; the prompts themselves are shuffled once, on the row id.
    """
    rows, id_column = _capped(df, spec)
    index = build_index(rows, id_column)
    firsts = distinct_contents(rows, spec.column, id_column)
    kept = rows.join(index.table.join(firsts, id_column), id_column)
    return kept.select("row_id", shard_rank(F.col("idx"), spec.world).alias("rank"),
                       _wave("idx", wave_units), "n_copies", spec.column)


def page_work(spark: SparkSession, spec: JobSpec, groups: int, listed: DataFrame | None = None) -> DataFrame:
    """Page paths, in waves by the hash of the path, as the files of a wave are found by it; no file is opened.
    ``listed`` spares the listing, and holds the same columns."""
    pages = list_pages(spark, spec.dataset, "_metadata.file_path") if listed is None else listed
    if spec.limit:
        pages = first_rows(pages, "row_id", spec.limit)
    numbered = build_index(pages, "row_id").attach(pages)
    wave = F.pmod(F.xxhash64("file_path"), F.lit(groups)).cast("bigint")
    return numbered.select("row_id", shard_rank(F.col("idx"), spec.world).alias("rank"),
                           wave.alias("wave"), F.lit(1).cast("bigint").alias("n_copies"), "path")
