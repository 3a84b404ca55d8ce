"""Parts, id sidecars, the commit log, markers, and the two views on one output.

One commit is one part: a folder ``part-<attempt>-<seq>[-r<first>_<last>].parquet`` written whole by Spark,
then its sidecar ``_manifest/ids-<same name>``, then its entry in the log, ``_log/<same name>.json``. A part
without a sidecar is a crash between the two. All names are known beforehand, so a commit lists
nothing and repeating it replaces it.

The log entry holds counts per wave and shard that Spark observes while it writes the part: progress, shard
stats, and what a resume needs to know come from it, and the part is not read for them. ``_begun/<same name>`` is
left before the part is written, so parts that a crash or a live launch leaves open are known without a
listing. A launch that ends folds its entries into one file, ``_folded/<attempt>.json``, a checkpoint of the log
that spares later readers from opening them one by one. The log is only ever appended to. The sidecar holds
the ids with their places in the part's files; only the narrow columns are read for it.
"""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inferlake.operators.healing import healed_files, healed_parts
from inferlake.sources.storage import create_new, delete, exists, file_names, write_json, write_text

MANIFEST_SCHEMA = ("row_id string, rank int, wave bigint, attempt bigint, ok boolean, "
                   "file string, pos bigint")
COUNTS = ("units", "ok", "prompt_tokens", "completion_tokens")
LOG_SCHEMA = ("part string, attempt bigint, cells array<struct<wave: bigint, rank: int, units: bigint, "
              "ok: bigint, prompt_tokens: bigint, completion_tokens: bigint>>")
TASK_IDS = 50_000     # ids of a sidecar that one task writes
OBSERVED_RANKS = 64   # shards of one commit: bounds the expressions that Spark observes
_RANKS = re.compile(r"-r(\d+)_(\d+)\.parquet$")


def part_name(attempt: int, seq: int, ranks: tuple[int, int] | None = None) -> str:
    """``ranks``: the first and the last shard of the part, where it holds some of them only."""
    shards = f"-r{ranks[0]}_{ranks[1]}" if ranks else ""
    return f"part-{attempt}-{seq:05d}{shards}.parquet"


def part_ranks(name: str) -> tuple[int, int] | None:
    found = _RANKS.search(name)
    return (int(found[1]), int(found[2])) if found else None


def write_part(results: DataFrame, root: str, name: str,
               rows_per_file: int | None = None) -> None:
    """One committed part; ``rows_per_file`` caps the rows of each file inside it."""
    writer = results.write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(f"{root}/{name}")


def _column(df: DataFrame, c: str, kind: str):
    return (F.col(c) if c in df.columns else F.lit(None)).cast(kind)


def write_manifest(spark: SparkSession, root: str, name: str, schema: StructType | None = None,
                   units: int | None = None) -> None:
    """Ids of a committed part and where they stand. Reads narrow columns only. With the part's schema and the number of
    its units at hand no file is opened for the one, and no task is spent on a few of the other."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    part = reader.parquet(f"{root}/{name}")
    if units is not None:
        part = part.coalesce(max(1, -(-units // TASK_IDS)))
    kinds = [c.split() for c in MANIFEST_SCHEMA.split(", ")[:4]]
    (part.select(*(_column(part, c, kind).alias(c) for c, kind in kinds), F.col("error").isNull().alias("ok"),
                 F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("pos"))
     .write.mode("overwrite").parquet(f"{root}/_manifest/ids-{name}"))


def _observed(results: DataFrame, ranks: list[int]) -> tuple[DataFrame, list[Observation]]:
    """``results`` with counts per shard taken while it is written.

    The model's output goes straight into the files, so the counts belong to the last stage, whose
    tasks count once however often they are tried.
    """
    watched = []
    for at in range(0, len(ranks), OBSERVED_RANKS):
        seen, metrics = Observation(), []
        for rank in ranks[at:at + OBSERVED_RANKS]:
            here, good = F.col("rank") == rank, F.col("error").isNull()
            metrics += [F.count_if(here).alias(f"units_{rank}"), F.count_if(here & good).alias(f"ok_{rank}")]
            metrics += [F.sum(F.when(here, _column(results, c, "bigint"))).alias(f"{c}_{rank}") for c in COUNTS[2:]]
        results = results.observe(seen, *metrics)
        watched.append(seen)
    return results, watched


def commit(results: DataFrame, root: str, name: str, rows_per_file: int | None = None,
           wave: int | None = None, ranks: list[int] | None = None, attempt: int | None = None) -> list[dict]:
    """Write a part, its sidecar and its log entry; the counts per (wave, rank).

    With ``wave``, ``ranks`` and ``attempt`` the counts are observed during the write; without them they are taken
    from the part's narrow columns.
    """
    spark = results.sparkSession
    write_text(spark, f"{root}/_begun/{name}", "begun")
    if ranks is None:
        write_part(results, root, name, rows_per_file)
        write_manifest(spark, root, name)
        return log_part(spark, root, name)
    watched_results, watched = _observed(results, ranks)
    write_part(watched_results, root, name, rows_per_file)
    found = {k: v for seen in watched for k, v in seen.get.items()}
    write_manifest(spark, root, name, results.schema, sum(found.get(f"units_{rank}") or 0 for rank in ranks))
    cells = [{"wave": wave, "rank": rank, **{c: found.get(f"{c}_{rank}") or 0 for c in COUNTS}} for rank in ranks]
    return _write_log(spark, root, name, attempt, [c for c in cells if c["units"]])


def _write_log(spark: SparkSession, root: str, name: str, attempt: int | None, cells: list[dict]) -> list[dict]:
    write_json(spark, f"{root}/_log/{name}.json", {"part": name, "attempt": attempt, "cells": cells})
    return cells


def new_attempt(spark: SparkSession, root: str) -> int:
    """A number, near the time in milliseconds, that no other launch of the run has."""
    attempt = time.time_ns() // 1_000_000
    while not create_new(spark, f"{root}/_folded/{attempt}.open", "open"):
        attempt += 1
    return attempt


def fold_log(spark: SparkSession, root: str, attempt: int, entries: list[dict]) -> None:
    """One file in place of the log entries of a launch that has ended; ``entries`` are all of them."""
    write_text(spark, f"{root}/_folded/{attempt}.json", "".join(json.dumps(e) + "\n" for e in entries))


def log_part(spark: SparkSession, root: str, name: str) -> list[dict]:
    """The log entry of a part that has none, from its narrow columns; a row per wave and shard."""
    part = spark.read.parquet(f"{root}/{name}")
    rows = part.groupBy(_column(part, "wave", "bigint").alias("wave"), _column(part, "rank", "int").alias("rank")).agg(
        F.count(F.lit(1)).alias("units"), F.count_if(F.col("error").isNull()).alias("ok"),
        *(F.coalesce(F.sum(_column(part, c, "bigint")), F.lit(0)).alias(c) for c in COUNTS[2:]),
        F.max(_column(part, "attempt", "bigint")).alias("attempt")).collect()
    cells = [{k: v for k, v in r.asDict().items() if k != "attempt"} for r in rows]
    return _write_log(spark, root, name, max((r["attempt"] or 0 for r in rows), default=0), cells)


def committed_parts(spark: SparkSession, root: str) -> list[str]:
    """Names of the parts whose sidecar is there."""
    parts = file_names(spark, root)
    sidecars = file_names(spark, f"{root}/_manifest")
    return sorted(n for n in parts if f"ids-{n}" in sidecars)


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """(part, attempt, cells) of each commit; parts of older outputs get their entry first."""
    logged = file_names(spark, f"{root}/_log")
    names = committed_parts(spark, root)
    for name in names:
        if f"{name}.json" not in logged:
            log_part(spark, root, name)
    if not names:
        return spark.createDataFrame([], LOG_SCHEMA)
    folded = {n.removesuffix(".json") for n in file_names(spark, f"{root}/_folded") if n.endswith(".json")}
    single = [n for n in names if n.split("-")[1] not in folded]
    paths = [f"{root}/_folded/{attempt}.json" for attempt in sorted(folded)] + [f"{root}/_log/{n}.json" for n in single]
    kept = spark.createDataFrame([(n,) for n in names], "part string")      # one row for each commit
    return spark.read.schema(LOG_SCHEMA).json(paths).join(kept, "part", "left_semi")


def log_counts(spark: SparkSession, root: str) -> DataFrame:
    """(part, attempt, wave, rank, and the counts)."""
    return read_log(spark, root).select("part", "attempt", F.inline("cells"))


def read_parts(spark: SparkSession, root: str) -> DataFrame:
    """The data view: parts by glob, never the root with its control files."""
    return spark.read.parquet(f"{root}/part-*.parquet")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The id view; empty before the first commit."""
    pattern = f"{root}/_manifest/ids-*.parquet"
    if not exists(spark, pattern):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(pattern)


def read_sidecar(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The ids of one commit."""
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/_manifest/ids-{name}")


def done_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids with a good record; failed ones are tried again on the next run."""
    return read_manifest(spark, root).where("ok").select("row_id", "wave")


def read_healed(spark: SparkSession, root: str, include_errors: bool = False) -> DataFrame:
    """One record per id, the good one before errors, then the latest."""
    names = committed_parts(spark, root)
    orphans = [n for n in file_names(spark, root) if n.startswith("part-") and n not in set(names)]
    if orphans or not names:     # a crash between part and sidecar: the parts alone tell
        return healed_files(read_parts(spark, root), include_errors)
    waves = {}
    for r in log_counts(spark, root).select("part", "wave").distinct().collect():    # a row per commit and wave
        waves.setdefault(r["wave"], set()).add(r["part"])
    shared = {p for wave, parts in waves.items() if wave is None or len(parts) > 1 for p in parts}
    return healed_parts(spark, root, names, shared, include_errors)


def create_views(spark: SparkSession, root: str, prefix: str) -> tuple[str, str]:
    """Temp views ``<prefix>_data`` and ``<prefix>_manifest``."""
    read_parts(spark, root).createOrReplaceTempView(f"{prefix}_data")
    read_manifest(spark, root).createOrReplaceTempView(f"{prefix}_manifest")
    return f"{prefix}_data", f"{prefix}_manifest"


def adopt_orphans(spark: SparkSession, root: str, ranks: list[int] | None = None) -> list[str]:
    """Give complete parts that lack a sidecar theirs, so their rows are not computed again.

    With ``ranks``, only parts of these shards: another shard's part may be one that is being committed.
    """
    sidecars = file_names(spark, f"{root}/_manifest")
    names = sorted(n for n in file_names(spark, root) if n.startswith("part-") and f"ids-{n}" not in sidecars)

    def is_mine(name: str) -> bool:
        of = part_ranks(name)
        return ranks is None or (of is not None and set(range(of[0], of[1] + 1)) <= set(ranks))

    kept = [n for n in names if is_mine(n) and exists(spark, f"{root}/{n}/_SUCCESS")]
    for name in kept:
        write_manifest(spark, root, name)
        log_part(spark, root, name)
    return kept


def write_ticks(spark: SparkSession, root: str, rank: int, epoch: int,
                ticks: list[dict]) -> None:
    """The telemetry file of a shard, written anew with each tick (stores cannot append)."""
    write_text(spark, f"{root}/telemetry-shard{rank}-{epoch}.jsonl",
               "".join(json.dumps(t) + "\n" for t in ticks))


def write_stats(spark: SparkSession, root: str, row: dict) -> None:
    write_json(spark, f"{root}/completions/stats-{row['rank']}.json", row)


def forget_markers(spark: SparkSession, root: str) -> None:
    """For a run that goes on: no shard counts as done."""
    for name in file_names(spark, f"{root}/completions"):
        if name.endswith(".done"):
            delete(spark, f"{root}/completions/{name}")


def write_completions(spark: SparkSession, root: str, stats: list[dict]) -> None:
    """``stats-N.json`` and then ``shard-N.done`` per rank (world rows at most)."""
    for row in stats:
        write_stats(spark, root, row)
    for row in stats:
        write_text(spark, f"{root}/completions/shard-{row['rank']}.done", "done")
