"""What runs left behind: file listings, shard stats, telemetry ticks, run records.

Every table carries ``run``, the name of the run's folder. ``output`` is one such folder,
or ``parent/*`` for all runs below a folder.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inferlake.functions.files import RUN_RECORD, STATS, TELEMETRY, file_kind
from inferlake.functions.ids import path_below
from inferlake.functions.text import stripped
from inferlake.sources.storage import absolute, exists, matching

CONTROL_FILES = ("completions/*", "telemetry-shard*.jsonl")
CONTROL_KINDS = ("marker", "stats", "telemetry")

LISTING_SCHEMA = ("run string, rel_path string, kind string, part string, "
                  "rank int, epoch bigint")
STATS_SCHEMA = (
    "rows_total bigint, rows_done_prior bigint, rows_processed bigint, rows_failed bigint, "
    "rows_deduped bigint, prompt_tokens bigint, completion_tokens bigint, elapsed_s double, "
    "final_limit int, input_bound boolean, breaker_opens int, hints array<string>, "
    "tokens_per_sec double, world int")
TICK_SCHEMA = ("t double, `limit` bigint, inflight bigint, waiting bigint, running bigint, "
               "bp bigint, ok bigint, input_bound boolean, tok_s double")
RECORD_SCHEMA = (
    "version int, task string, run_id string, slug string, expected_rows bigint, "
    "items_per_row int, expected_items bigint, world int, num_examples bigint, "
    "created_at timestamp")


def _root_of(spark: SparkSession, output: str) -> tuple[str, str]:
    """(folder to load, absolute folder the run names and relative paths start from)."""
    output = output.rstrip("/")
    if output.endswith("/*"):
        return output, absolute(spark, output[:-2])
    return output, absolute(spark, output).rsplit("/", 1)[0]


def _located(path: Column, base: str) -> Column:
    """struct(run, rel_path) of an absolute path below ``base``/<run>/."""
    below = path_below(path, base)
    return F.struct(F.substring_index(below, "/", 1).alias("run"),
                    F.substring(below, F.locate("/", below) + 1, F.length(below))
                    .alias("rel_path"))


def _file_path() -> Column:
    """The file a row comes from, without URI escapes."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _classified(paths: DataFrame, base: str) -> DataFrame:
    return (paths.select(_located(F.col("path"), base).alias("at"))
            .select("at.run", "at.rel_path", file_kind(F.col("at.rel_path")).alias("k"))
            .select("run", "rel_path", "k.kind", "k.part", "k.rank", "k.epoch"))


def _paths(spark: SparkSession, *patterns: str) -> DataFrame:
    """(path) of the files at or below patterns; a scan, so empty files are not among them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = [reader.load(p).select("path") for p in patterns if exists(spark, p)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "path string")


def list_outputs(spark: SparkSession, output: str, audit: bool = False) -> DataFrame:
    """(run, rel_path, kind, part, rank, epoch) for what the run or runs hold.

    The parts of runs with a commit log are read from it, one row each; only parts that were begun and never
    committed are looked for, so no folder of finished data is listed. Outputs of other writers, and with ``audit`` all of them, are listed
    file by file. A missing folder gives no rows.
    """
    folder, base = _root_of(spark, output)
    logged = [] if audit else [p.rsplit("/", 1)[0] for p in matching(spark, f"{folder}/_log")]   # one per run
    if not logged:
        return _listed(spark, [folder], base)
    files = _from_logs(spark, folder, base, logged)
    if not folder.endswith("/*"):
        return files
    others = sorted(p for p in set(matching(spark, folder)) - set(logged) if p.rsplit("/", 1)[-1][0] not in "_.")
    return files.unionByName(_listed(spark, others, base)) if others else files


def _from_logs(spark: SparkSession, folder: str, base: str, logged: list[str]) -> DataFrame:
    """The files of the runs below ``folder`` that have a log."""
    at = _located(_file_path(), base).alias("at")
    parts = _logged_parts(spark, folder, at)
    commits = parts.select("run", F.col("part").alias("rel_path"))
    small = _paths(spark, *(f"{folder}/{pattern}" for pattern in ("_manifest", *CONTROL_FILES, "run.json")))
    if folder.endswith("/*"):      # the other runs' are listed with their other files
        small = small.where(_located(F.col("path"), base)["run"].isin([p.rsplit("/", 1)[-1] for p in logged]))
    return (commits.select("run", "rel_path", file_kind(F.col("rel_path")).alias("k"))
            .select("run", "rel_path", "k.kind", "k.part", "k.rank", "k.epoch")
            .unionByName(_classified(small, base)).unionByName(_classified(_open_parts(spark, folder, base, parts), base)))


def _logged_parts(spark: SparkSession, folder: str, at: Column) -> DataFrame:
    """(run, part) of every commit: from one file per launch that has ended, and from the entries of the others."""
    read = spark.read.schema("part string")
    entries = read.json(f"{folder}/_log").select(at, "part")
    folded = matching(spark, f"{folder}/_folded/*.json")       # one path per launch
    if folded:      # a filter on the path alone: entries of these launches are not opened
        done = [f"{run.rsplit('/', 1)[-1]}/part-{name.removesuffix('.json')}" for run, name in (p.split("/_folded/") for p in folded)]
        launch = F.concat_ws("/", "at.run", F.regexp_extract("at.rel_path", r"^_log/(part-\d+)-", 1))
        entries = entries.where(~launch.isin(done)).unionByName(read.json(folded).select(at, "part"))
    return entries.where("part is not null").select("at.run", "part")


def _open_parts(spark: SparkSession, folder: str, base: str, parts: DataFrame) -> DataFrame:
    """(path) of the files of parts that were begun and have no log entry: what crashes and live launches left."""
    at = _located(F.col("path"), base)
    begun = _paths(spark, f"{folder}/_begun").select(at["run"].alias("run"), F.substring_index(at["rel_path"], "/", -1).alias("part"))
    left = begun.join(parts, ["run", "part"], "left_anti").collect()      # at most one for each launch that never ended
    above = folder.removesuffix("/*") if folder.endswith("/*") else folder.rsplit("/", 1)[0]
    return _paths(spark, *(f"{above}/{r['run']}/{r['part']}" for r in left))


def _listed(spark: SparkSession, folders: list[str], base: str) -> DataFrame:
    """Every file. Spark skips names that start with ``_``, so sidecars are listed by their own path. A
    scan also skips empty files; markers and fresh telemetry of other writers may be empty, so those few are
    taken from the file index instead."""
    found = _paths(spark, *(p for f in folders for p in (f, f"{f}/_manifest")))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    control = [unquote(name) for f in folders for pattern in CONTROL_FILES if exists(spark, f"{f}/{pattern}")
               for name in reader.load(f"{f}/{pattern}").inputFiles()]
    scanned = _classified(found, base)
    indexed = _classified(spark.createDataFrame([(c,) for c in control], "path string"), base)
    return (scanned.where(~F.col("kind").isin(*CONTROL_KINDS))
            .unionByName(indexed.where(F.col("kind").isin(*CONTROL_KINDS))))


def _fields(schema: str) -> list[Column]:
    """The fields of a JSON object ``v``, each read on its own: an odd one is null, and takes
    no other with it."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    return [F.expr(f"try_variant_get(v, '$.{name.strip('`')}', '{kind}')").alias(name.strip("`"))
            for name, kind in fields]


def _object(text: str = "value") -> Column:
    """Valid JSON objects as a variant; null for anything else."""
    v = F.try_parse_json(F.col(text))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _text_of(spark: SparkSession, glob: str, whole: bool) -> DataFrame | None:
    if not exists(spark, glob):
        return None
    return spark.read.text(glob, wholetext=whole)


def read_stats(spark: SparkSession, output: str) -> DataFrame:
    """(run, rank, stats fields); the rank is in the file name, unreadable files are left out."""
    folder, base = _root_of(spark, output)
    text = _text_of(spark, f"{folder}/completions/stats-*.json", whole=True)
    if text is None:
        return spark.createDataFrame([], f"run string, rank int, {STATS_SCHEMA}")
    return (text.select(_located(_file_path(), base).alias("at"), _object().alias("v"))
            .where("v is not null")
            .select("at.run", F.regexp_extract("at.rel_path", STATS, 1).cast("int").alias("rank"),
                    *_fields(STATS_SCHEMA)))


def read_ticks(spark: SparkSession, output: str) -> DataFrame:
    """(run, rank, epoch, rel_path, line, tick fields).

    Files are read by line, so a long log is split over tasks; (block, row) keeps the
    order of lines within a file. One bad line removes its whole file.
    """
    folder, base = _root_of(spark, output)
    text = _text_of(spark, f"{folder}/telemetry-shard*.jsonl", whole=False)
    if text is None:
        return spark.createDataFrame(
            [], "run string, rank int, epoch bigint, rel_path string, "
                f"line struct<block:bigint,row:bigint>, {TICK_SCHEMA}")
    lines = (text.select(
        "value", _located(_file_path(), base).alias("at"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("line"))
        .where(F.col("at.rel_path").rlike(TELEMETRY) & (stripped(F.col("value")) != "")))
    parsed = lines.select("at.*", "line", _object().alias("v"))
    bad_files = parsed.where("v is null").select("run", "rel_path").distinct()
    return (parsed.join(bad_files, ["run", "rel_path"], "left_anti")
            .select("run",
                    F.regexp_extract("rel_path", TELEMETRY, 1).cast("int").alias("rank"),
                    F.regexp_extract("rel_path", TELEMETRY, 2).cast("bigint").alias("epoch"),
                    "rel_path", "line", *_fields(TICK_SCHEMA)))


def read_run_records(spark: SparkSession, output: str) -> DataFrame:
    """(run, record fields, spec and resolved as JSON text); unreadable records are left out."""
    folder, base = _root_of(spark, output)
    text = _text_of(spark, f"{folder}/run.json", whole=True)
    if text is None:
        return spark.createDataFrame(
            [], f"run string, {RECORD_SCHEMA}, spec string, resolved string")
    at = _located(_file_path(), base)
    json_text = [F.to_json(F.expr(f"variant_get(v, '$.{name}', 'variant')")).alias(name)
                 for name in ("spec", "resolved")]
    return (text.select(at.alias("at"), _object().alias("v"))
            .where(F.col("at.rel_path").rlike(RUN_RECORD) & F.col("v").isNotNull())
            .select("at.run", *_fields(RECORD_SCHEMA), *json_text))
