"""Progress of any number of runs, from their output files alone.

Inputs are the tables of ``sources.outputs``; each carries ``run``. Everything is
aggregated per run before it is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inferlake.functions.sizing import progress_ratio

TICK_WINDOW = 120   # ticks kept per shard
DOCUMENT_VERSION = 1


def shard_stats(units: DataFrame, error: str = "error") -> DataFrame:
    """Per (run, rank): totals, failures and token sums of processed units.

    Failed units are counted apart and stay part of ``rows_processed``.
    """
    return units.groupBy("run", "rank").agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if("done_prior").alias("rows_done_prior"),
        F.count_if(~F.col("done_prior")).alias("rows_processed"),
        F.count_if(F.col(error).isNotNull()).alias("rows_failed"),
        F.sum("copies_dropped").alias("rows_deduped"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"))


def with_token_rate(stats: DataFrame, elapsed: str = "elapsed_s") -> DataFrame:
    tokens = (F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    return stats.withColumn("tokens_per_sec", F.try_divide(tokens.cast("double"),
                                                           F.col(elapsed)))


def orphan_parts(files: DataFrame) -> DataFrame:
    """(run, part) without an id sidecar."""
    parts = files.where(F.col("kind") == "part").select("run", "part").distinct()
    sidecars = files.where(F.col("kind") == "manifest").select("run", "part")
    return parts.join(sidecars, ["run", "part"], "left_anti")


def storage_counts(files: DataFrame) -> DataFrame:
    """(run, parts, orphans)."""
    by_part = (files.where(F.col("kind").isin("part", "manifest")).groupBy("run", "part")
               .agg(F.bool_or(F.col("kind") == "part").alias("written"),
                    F.bool_or(F.col("kind") == "manifest").alias("listed")))
    return by_part.groupBy("run").agg(
        F.count_if("written").alias("parts"),
        F.count_if(F.col("written") & ~F.col("listed")).alias("orphans"))


def shard_traces(files: DataFrame, stats: DataFrame) -> DataFrame:
    """(run, rank, done, stats) for every rank with a marker, telemetry or readable stats."""
    marks = (files.where(F.col("kind").isin("marker", "telemetry")).groupBy("run", "rank")
             .agg(F.bool_or(F.col("kind") == "marker").alias("done")))
    fields = [c for c in stats.columns if c not in ("run", "rank")]
    packed = stats.select("run", "rank", F.struct(*fields).alias("stats"))
    return (marks.join(packed, ["run", "rank"], "full")
            .select("run", "rank", F.coalesce("done", F.lit(False)).alias("done"), "stats"))


def world_size(files: DataFrame, stats: DataFrame, records: DataFrame) -> DataFrame:
    """(run, world, world_inferred): lowest rank's stats, else the run record (even when it
    has no world), else one more than the highest rank seen, flagged."""
    with_stats = F.when(F.col("stats").isNotNull(), F.col("rank"))
    seen = shard_traces(files, stats).groupBy("run").agg(
        F.min_by("stats.world", with_stats).alias("by_stats"), F.max("rank").alias("top"))
    intent = records.select("run", F.col("world").alias("by_record"),
                            F.lit(True).alias("has_record"))
    has_record = F.coalesce("has_record", F.lit(False))
    guess = F.when(~has_record, F.col("top") + 1)
    return seen.join(intent, "run", "full").select(
        "run",
        F.coalesce("by_stats", F.when(has_record, F.col("by_record")), guess).alias("world"),
        (F.col("by_stats").isNull() & guess.isNotNull()).alias("world_inferred"))


def _runs(*tables: DataFrame) -> DataFrame:
    runs = tables[0].select("run")
    for t in tables[1:]:
        runs = runs.unionByName(t.select("run"))
    return runs.distinct()


def progress(stats: DataFrame, ticks: DataFrame, records: DataFrame,
             runs: DataFrame | None = None) -> DataFrame:
    """One row per run. Exact as soon as one shard has stats; otherwise the sum of all
    ticks, which misses the tail, with unknown failures."""
    exact = stats.groupBy("run").agg(
        F.sum(F.coalesce("rows_done_prior", F.lit(0)) + F.coalesce("rows_processed", F.lit(0)))
        .alias("exact_ok"),
        F.sum(F.coalesce("rows_failed", F.lit(0))).alias("exact_failed"),
        F.lit(True).alias("has_stats"))
    approx = ticks.groupBy("run").agg(F.sum(F.coalesce("ok", F.lit(0))).alias("tick_ok"))
    intent = records.select("run", "expected_rows", "items_per_row", "expected_items",
                            F.lit(True).alias("has_record"))
    runs = _runs(stats, ticks, records) if runs is None else runs.select("run").distinct()
    is_exact = F.coalesce("has_stats", F.lit(False))
    rows_ok = F.when(is_exact, F.col("exact_ok")).otherwise(F.coalesce("tick_ok", F.lit(0)))
    joined = (runs.join(exact, "run", "left").join(approx, "run", "left")
              .join(intent, "run", "left").withColumn("rows_ok", rows_ok))
    return joined.select(
        "run", "rows_ok",
        F.when(is_exact, F.col("exact_failed")).alias("rows_failed"),
        "expected_rows",
        progress_ratio(F.col("rows_ok"), F.col("expected_rows")).alias("pct"),
        is_exact.alias("exact"), "items_per_row",
        F.when(F.col("items_per_row") != 0, F.col("rows_ok") * F.col("items_per_row"))
        .alias("items_ok"),
        "expected_items", F.coalesce("has_record", F.lit(False)).alias("has_run_json"))


def shard_roster(files: DataFrame, stats: DataFrame, world: DataFrame) -> DataFrame:
    """(run, rank, done, stats): every rank that left a trace or is below the world size."""
    planned = (world.where("world > 0")
               .select("run", F.explode(F.sequence(F.lit(0), F.col("world") - 1)).alias("rank")))
    return (shard_traces(files, stats).join(planned, ["run", "rank"], "full")
            .select("run", "rank", F.coalesce("done", F.lit(False)).alias("done"), "stats"))


def known_shards(files: DataFrame, stats: DataFrame, records: DataFrame) -> DataFrame:
    """``shard_roster`` over ``world_size``, with the traces planned once: the shards of a run, at most as many
    as its world or as left a trace, meet in one row, and the missing ones are added there."""
    with_stats = F.when(F.col("stats").isNotNull(), F.col("rank"))
    seen = shard_traces(files, stats).groupBy("run").agg(
        F.min_by("stats.world", with_stats).alias("by_stats"), F.max("rank").alias("top"),
        F.collect_list(F.struct("rank", "done", "stats")).alias("left"))
    intent = records.select("run", F.col("world").alias("by_record"), F.lit(True).alias("has_record"))
    joined = seen.join(intent, "run", "full")
    shard = joined.schema["left"].dataType.elementType.simpleString()
    world = F.coalesce("by_stats", F.when(F.col("has_record"), F.col("by_record")).otherwise(F.col("top") + 1), F.lit(0))
    planned = F.when(world > 0, F.sequence(F.lit(0), world - 1)).otherwise(F.array().cast("array<int>"))
    left = F.coalesce("left", F.array().cast(f"array<{shard}>"))
    absent = F.array_except(planned, F.transform(left, lambda s: s["rank"]))
    added = F.transform(absent, lambda rank: F.struct(
        rank.alias("rank"), F.lit(False).alias("done"), F.lit(None).cast(joined.schema["left"].dataType.elementType["stats"].dataType)
        .alias("stats")))
    return joined.select("run", F.inline(F.concat(left, added)))


def all_done(roster: DataFrame) -> DataFrame:
    """(run, complete): it has shards and all of them are done."""
    return roster.groupBy("run").agg(
        (F.bool_and("done") & (F.count(F.lit(1)) > 0)).alias("complete"))


def newest_files(files: DataFrame) -> DataFrame:
    """(run, rank, rel_path) of the newest telemetry file per shard, readable or not."""
    newest = F.max(F.struct("epoch", "rel_path"))
    return (files.where(F.col("kind") == "telemetry").groupBy("run", "rank")
            .agg(newest.alias("n")).select("run", "rank", "n.rel_path"))


def tick_window(files: DataFrame, ticks: DataFrame, size: int = TICK_WINDOW) -> DataFrame:
    """The last ``size`` ticks of the newest file per shard.

    Ticks of older files go before anything is ranked, and the rank filter works before the
    shuffle, so at most ``size`` ticks per shard leave a map task. A shard whose newest file
    is unreadable has no window.
    """
    newest = ticks.join(newest_files(files), ["run", "rank", "rel_path"], "left_semi")
    latest = Window.partitionBy("run", "rank").orderBy(F.col("line").desc())
    return newest.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= size).drop("_n")


def document(output: str, files: DataFrame, stats: DataFrame, ticks: DataFrame,
             records: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run, document): the versioned JSON form of the four tables."""
    runs = _runs(files, stats, records) if runs is None else runs
    world = world_size(files, stats, records)
    shards = (known_shards(files, stats, records).groupBy("run")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "done", "stats")),
                                lambda a, b: a["rank"] - b["rank"]).alias("shards")))
    fields = ["t", "limit", "inflight", "waiting", "running", "bp", "ok", "input_bound", "tok_s"]
    tick = F.struct("line", F.struct(*fields).alias("tick"))
    per_shard = (tick_window(files, ticks).groupBy("run", "rank")
                 .agg(F.array_sort(F.collect_list(tick),
                                   lambda a, b: F.when(a["line"] < b["line"], -1).otherwise(1))
                      .alias("t")))
    telemetry = per_shard.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("rank").cast("string"), F.transform("t", lambda x: x["tick"])))).alias("telemetry"))
    summary = progress(stats, ticks, records, runs)
    return (summary.select("run", F.struct(*[c for c in summary.columns if c != "run"])
                           .alias("progress"))
            .join(storage_counts(files), "run", "left").join(world, "run", "left")
            .join(shards, "run", "left").join(telemetry, "run", "left")
            .join(records.select("run", "run_id", "spec"), "run", "left")
            .select("run", F.to_json(F.struct(
                F.lit(DOCUMENT_VERSION).alias("version"), "run_id",
                F.lit(output).alias("output"), F.try_parse_json("spec").alias("spec"), "progress",
                F.coalesce("shards", F.array()).alias("shards"),
                F.struct(F.coalesce("parts", F.lit(0)).alias("parts"),
                         F.coalesce("orphans", F.lit(0)).alias("orphans"), "world",
                         F.coalesce("world_inferred", F.lit(False)).alias("world_inferred"))
                .alias("storage"), "telemetry"),
                {"ignoreNullFields": "false"}).alias("document")))
