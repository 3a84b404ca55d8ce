"""Registered queries: runs that are launched, resumed, split, grown and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from inferlake.plans import runs
from inferlake.plans.queries_rows import (
    BATCH, SQL_ATTEMPTS, SQL_CLEANED, SQL_ROW_ID, committed_run, documents, table,
)
from inferlake.session import shared_path
from inferlake.sources import sinks
from inferlake.spec import JobSpec
from inferlake.streaming import inference as stream_inference
from inferlake.streaming.watch import until_done

SHARDS = 3
SHARD = 1


def _source(spark, sf_dir):
    return f"{sf_dir}/documents.parquet"


def _embed(spark, sf_dir, name, **options):
    # about a quarter of the batches per commit
    wave_units = -(-documents(spark, sf_dir).count() // (4 * BATCH))
    return runs.embed(spark, _source(spark, sf_dir), output=shared_path(spark, name), column="text", id_column="doc_id",
                      wave_units=wave_units, **options)


def commit_metrics(spark, sf_dir):
    """Counts per commit and shard as they were observed while the parts were written."""
    done = _embed(spark, sf_dir, "commit-metrics", world=SHARDS)
    return sinks.log_counts(spark, done.output).select("wave", "rank", "units", "ok", "prompt_tokens", "completion_tokens")


def one_shard_run(spark, sf_dir):
    """A launch of one shard alone, before any other: its marker, stats and rows are there, no other shard's are."""
    plan = _embed(spark, sf_dir, "one-shard", world=SHARDS, launch=False)
    done = runs.launch(plan, ranks=[SHARD])
    rows = done.results().groupBy("rank").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_texts").alias("n_texts"))
    return done.status().shards.join(rows, "rank", "left").select(
        "rank", "done", "stats.rows_total", "stats.rows_processed", "n_rows", "n_texts")


def resume_grown_source(spark, sf_dir):
    """A run over the even documents, and again after a file of the odd ones has come to its source."""
    docs, folder = documents(spark, sf_dir).select("doc_id", "text"), shared_path(spark, "grown-source")
    docs.where("doc_id % 2 = 0").write.parquet(folder)
    output = shared_path(spark, "grown-run")
    options = dict(output=output, column="text", id_column="doc_id", world=SHARDS)
    runs.embed(spark, folder, **options)
    docs.where("doc_id % 2 <> 0").write.mode("append").parquet(folder)
    done = runs.embed(spark, folder, **options)
    return done.results().select("row_id", "wave", "rank", "n_texts", "prompt_tokens")


def healed_with_errors(spark, sf_dir):
    """Every id of three attempts once, errors included, through deletion vectors."""
    return sinks.read_healed(spark, committed_run(spark, sf_dir), include_errors=True).select(
        "row_id", "attempt", "error", "text")


def stream_publish(spark, sf_dir):
    """A stream without ids as a full run: its record, stats and marker let it be published like any other."""
    output = shared_path(spark, "stream-run")
    spec = JobSpec(task="embeddings", dataset="documents", model="hash-embedder", output=output, batch=BATCH)
    documents_stream = spark.readStream.schema(documents(spark, sf_dir).schema).parquet(f"{sf_dir}/documents.parque[t]")
    run = stream_inference.start(documents_stream, spec, shared_path(spark, "stream-checkpoint"))
    run.awaitTermination()
    clean = spark.read.parquet(run.publish(shared_path(spark, "stream-published")))
    progress = run.status().progress.select("rows_ok", "rows_failed", "exact")
    texts = clean.select(F.explode("texts").alias("text")).groupBy(F.sha2("text", 256).alias("content")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    return texts.join(progress)      # one row of totals


def stream_until_done(spark, sf_dir):
    """Progress that is followed while a run works; the final rows, after which the stream has stopped by itself."""
    plan = _embed(spark, sf_dir, "watched", world=SHARDS, launch=False)
    runs.launch(plan, ranks=[SHARD])
    watch = until_done(spark, [plan.spec.output], shared_path(spark, "watch-checkpoint"))
    runs.launch(plan)
    if not watch.wait(600):
        raise RuntimeError("the run is done, but its progress did not end")
    facts = list(watch.final.values())
    return spark.createDataFrame([(f["rows_ok"], f["rows_failed"], f["shards_done"], f["world"], f["final"], watch.query.isActive)
                                  for f in facts], "rows_ok bigint, rows_failed bigint, shards_done int, world int, final boolean, active boolean")


def stream_dedup_window(spark, sf_dir):
    """A generation stream whose state is bounded by a time column; a content that comes again is answered once in the results."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select(
        F.col("props").alias("text"), F.col("ts").cast("timestamp").alias("at"))
    spec = JobSpec(task="generation", dataset="events", model="echo", output=shared_path(spark, "stream-window"))
    run = stream_inference.start(events, spec, shared_path(spark, "stream-checkpoint"), time_column="at", delay="2 hours")
    run.awaitTermination()
    return run.results().select("row_id", "response")


def generate_run_all_rows(spark, sf_dir):
    """The answers of a launched run on every source row, from the run's handle."""
    done = runs.generate(spark, _source(spark, sf_dir), model="echo", output=shared_path(spark, "generation-rows"),
                         column="text", id_column="doc_id", world=SHARDS)
    return done.all_rows().select("doc_id", "row_id", "response", "prompt_tokens", "completion_tokens", "error")


SQL_NUMBERED = f"""{SQL_CLEANED}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM cleaned),
units AS (
  SELECT idx // {BATCH} AS batch_no, CAST(idx // {BATCH} % {SHARDS} AS INTEGER) AS rank, count(*) AS n_texts,
         CAST(sum(len(list_filter(string_split(text, ' '), lambda t: t <> ''))) AS BIGINT) AS tokens
  FROM numbered GROUP BY ALL)"""
SQL_WAVE_UNITS = f"(SELECT CAST(ceil(count(*) / (4.0 * {BATCH})) AS BIGINT) FROM documents)"

SQL_GROWN = f"""WITH {SQL_CLEANED}, numbered AS (
  SELECT *, doc_id % 2 AS later, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS idx FROM cleaned)
SELECT 'b-' || min(doc_id) AS row_id, CAST(later AS BIGINT) AS wave, CAST(idx // {BATCH} % {SHARDS} AS INTEGER) AS rank,
       CAST(count(*) AS INTEGER) AS n_texts,
       CAST(sum(len(list_filter(string_split(text, ' '), lambda t: t <> ''))) AS BIGINT) AS prompt_tokens
FROM numbered GROUP BY later, idx // {BATCH}"""

QUERIES = {
    "commit_metrics": (commit_metrics, f"""WITH {SQL_NUMBERED}
        SELECT batch_no // {SQL_WAVE_UNITS} AS wave, rank, count(*) AS units, count(*) AS ok,
               CAST(sum(tokens) AS BIGINT) AS prompt_tokens, CAST(0 AS BIGINT) AS completion_tokens
        FROM units GROUP BY ALL"""),
    "one_shard_run": (one_shard_run, f"""WITH {SQL_NUMBERED}, ranks AS (
          SELECT CAST(unnest(range({SHARDS})) AS INTEGER) AS rank), sums AS (
          SELECT rank, count(*) AS n, CAST(sum(n_texts) AS BIGINT) AS n_texts FROM units WHERE rank = {SHARD} GROUP BY rank)
        SELECT rank, rank = {SHARD} AS done, n AS rows_total, n AS rows_processed, n AS n_rows, n_texts
        FROM ranks LEFT JOIN sums USING (rank)"""),
    "resume_grown_source": (resume_grown_source, SQL_GROWN),
    "healed_with_errors": (healed_with_errors, f"""WITH {SQL_ATTEMPTS} SELECT row_id,
        CAST(attempt AS BIGINT) AS attempt, error, text FROM picked WHERE pick = 1"""),
    "stream_publish": (stream_publish, f"""WITH {SQL_CLEANED}, texts AS (
          SELECT sha256(text) AS content, count(*) AS n_rows FROM cleaned GROUP BY ALL)
        SELECT content, n_rows, (SELECT CAST(ceil(count(*) / {BATCH}.0) AS BIGINT) FROM cleaned) AS rows_ok,
               CAST(0 AS BIGINT) AS rows_failed, true AS exact FROM texts"""),
    "stream_until_done": (stream_until_done, f"""WITH {SQL_NUMBERED}
        SELECT count(*) AS rows_ok, CAST(0 AS BIGINT) AS rows_failed, {SHARDS} AS shards_done, {SHARDS} AS world,
               true AS final, false AS active FROM units"""),
    "stream_dedup_window": (stream_dedup_window, """SELECT DISTINCT coalesce(sha256(props), 'null') AS row_id,
        'echo: ' || props AS response FROM events"""),
    "generate_run_all_rows": (generate_run_all_rows, f"""SELECT doc_id, {SQL_ROW_ID} AS row_id, 'echo: ' || text AS response,
        length(text) AS prompt_tokens, length(text) + 6 AS completion_tokens, CAST(NULL AS VARCHAR) AS error FROM documents"""),
}
