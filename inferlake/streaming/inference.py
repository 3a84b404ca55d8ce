"""Results land while the source is still growing; a restart continues from the checkpoint.

A stream leaves what a launched run leaves: a record, one committed part with its sidecar and log entry per stream
batch, ticks, stats, and at the end the marker. All names come from the stream batch, so a batch
that is replayed after a failure replaces its own files, and no count is taken twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inferlake import models
from inferlake.functions.ids import path_below
from inferlake.functions.text import clean_text
from inferlake.operators import inference
from inferlake.operators.batching import micro_batch
from inferlake.plans import runs
from inferlake.session import stage, temporary_stages
from inferlake.sources import sinks
from inferlake.sources.pages import split_glob
from inferlake.sources.storage import absolute
from inferlake.sources.tables import with_position
from inferlake.spec import JobSpec
from inferlake.streaming.dedup import dedup_stream

SHARD = 0               # a stream is one shard
TICK_FILE_BATCHES = 500  # stream batches that share a telemetry file


def _results(batch: DataFrame, spec: JobSpec, factory: Callable, batch_id: int) -> DataFrame:
    if spec.task == "generation":
        return inference.generate_rows(batch.select("row_id", spec.column), spec.column,
                                       spec.model, factory, spec.max_tokens, spec.temperature)
    if spec.task == "ocr":
        folder = absolute(batch.sparkSession, split_glob(spec.dataset)[0])
        rows = batch.select(path_below(F.col("path"), folder).alias("row_id"), "content")
        return inference.read_pages(rows, "content", spec.model, factory, spec.settings.get("prompt"),
                                    spec.max_tokens, spec.temperature, spec.settings.get("top_p", 0.9))
    # numbering reads its input more than once; the staged copy also fixes batch membership
    id_column = spec.id_column or "_position"
    if spec.id_column is None:      # equal rows are numbered, and ids begin with the stream batch
        placed = with_position(batch, [spec.column], id_column)
        batch = placed.withColumn(id_column, F.concat(F.lit(f"{batch_id:012d}-"), id_column))
    rows = stage(clean_text(batch.select(id_column, spec.column), spec.column, spec.truncate), "stream-batch")
    units = micro_batch(rows, id_column, spec.column, spec.batch)
    return inference.embed_units(units.drop("batch_no"), spec.model, factory)


class Ledger:
    """Counts of a stream's batches, and the control files that follow from them.

    What is known after a restart comes from the log, so writing a batch again changes nothing.
    """

    def __init__(self, spark: SparkSession, spec: JobSpec):
        self.spark, self.spec, self.started = spark, spec, time.monotonic()
        rows = sinks.log_counts(spark, spec.output).groupBy("part").agg(
            *(F.sum(c).alias(c) for c in sinks.COUNTS)).collect()     # one row for each stream batch
        self.parts = {r["part"]: {c: r[c] for c in sinks.COUNTS} for r in rows}

    def add(self, part: str, batch_id: int, cells: list[dict]) -> None:
        self.parts[part] = {c: sum(cell[c] for cell in cells) for c in sinks.COUNTS}
        first = batch_id // TICK_FILE_BATCHES * TICK_FILE_BATCHES
        names = {n: sinks.part_name(0, n) for n in range(first, first + TICK_FILE_BATCHES)}
        ticks = [{"t": n, "ok": self.parts[name]["ok"]} for n, name in names.items() if name in self.parts]
        sinks.write_ticks(self.spark, self.spec.output, SHARD, first, ticks)
        sinks.write_stats(self.spark, self.spec.output, self.stats())

    def stats(self) -> dict:
        total = {c: sum(p[c] for p in self.parts.values()) for c in sinks.COUNTS}
        elapsed = time.monotonic() - self.started
        tokens = total["prompt_tokens"] + total["completion_tokens"]
        return {"rank": SHARD, "world": 1, "rows_total": total["units"], "rows_done_prior": 0, "rows_deduped": 0,
                "rows_processed": total["units"], "rows_failed": total["units"] - total["ok"],
                "prompt_tokens": total["prompt_tokens"], "completion_tokens": total["completion_tokens"],
                "elapsed_s": elapsed, "tokens_per_sec": tokens / elapsed if elapsed else None}


@dataclass
class StreamRun(runs.Run):
    """A run that is fed by a stream: the run handle, and the stream's query."""

    query: StreamingQuery | None = None
    ledger: Ledger | None = None

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        """As of a query; a stream that has read all there is leaves its marker."""
        ended = self.query.awaitTermination(timeout) if timeout is not None else self.query.awaitTermination()
        if timeout is None or ended:
            self.finish()
        return ended

    def stop(self) -> None:
        """End a stream that would go on; its run is then complete."""
        self.query.stop()
        self.finish()

    def finish(self) -> None:
        sinks.write_completions(self.spark, self.spec.output, [self.ledger.stats()])
        if self.spec.publish:
            self.publish(self.spec.publish)


def start(stream: DataFrame, spec: JobSpec, checkpoint: str, model: Callable | None = None,
          trigger: dict | None = None, time_column: str | None = None, delay: str = "1 day") -> StreamRun:
    """Apply the model to a stream and commit one part per stream batch.

    Batch ids of embeddings follow the stream batches; the checkpoint owns the resume. With
    ``time_column`` the ids of a generation stream are forgotten ``delay`` after their time, so the state is
    bounded: a copy that comes later than that is asked again, and results hold the newest good
    answer of each content.
    """
    spark = stream.sparkSession
    factory = model or models.build(spec.model, spec.settings.get("model"))
    if spec.task == "generation":
        stream = dedup_stream(stream, spec.column, time_column, delay)
    record = runs.open_record(spark, spec, runs.new_record(spec, {**spec.identity(), "source": "stream"}, {}, world=1))
    sinks.forget_markers(spark, spec.output)      # a restarted stream is not done
    sinks.adopt_orphans(spark, spec.output)
    ledger = Ledger(spark, spec)
    # copies may come again once their id is forgotten: then any two parts may hold the same content
    apart = time_column is None

    def commit(batch: DataFrame, batch_id: int) -> None:
        number = F.lit(batch_id).cast("bigint")
        part = sinks.part_name(0, batch_id)
        with temporary_stages(batch.sparkSession):
            results = (_results(batch, spec, factory, batch_id).withColumn("rank", F.lit(SHARD))
                       .withColumn("wave", number).withColumn("attempt", number))
            cells = sinks.commit(results, spec.output, part, None, batch_id if apart else None, [SHARD], batch_id)
        ledger.add(part, batch_id, cells)

    query = (stream.writeStream.foreachBatch(commit)
             .option("checkpointLocation", checkpoint)
             .trigger(**(trigger or {"availableNow": True})).start())
    return StreamRun(spark, spec, record, query, ledger)
