"""Live progress that ends: totals per run while it works, one final row when all shards are done, and then nothing.

The commit log and the completion markers of a run are followed as two file streams. A stateful processor
keeps one state per run: totals, the shards that are done, and a timer. Every change gives a row; a run that is silent for
``silence`` seconds gives a row marked ``stalled`` when the timer goes off; once the last marker is there, the timer
brings the final row, after which the run's totals are dropped. The query stops by itself once every watched run has its final row.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from inferlake.session import use_disk_state
from inferlake.sources.sinks import LOG_SCHEMA
from inferlake.sources.storage import make_folder, read_json

EVENT = "run string, world int, units bigint, ok bigint, done_rank int"
OUT = "run string, rows_ok bigint, rows_failed bigint, shards_done int, world int, stalled boolean, final boolean"
SILENCE = 600.0


def events(spark: SparkSession, output: str) -> DataFrame:
    """Stream of what happens in one run: commits with their counts, and markers."""
    root = output.rstrip("/")
    record = read_json(spark, f"{root}/run.json") or {}
    for folder in ("_log", "completions"):
        make_folder(spark, f"{root}/{folder}")
    facts = [F.lit(root.rsplit("/", 1)[-1]).alias("run"), F.lit(record.get("world")).cast("int").alias("world")]
    log = spark.readStream.schema(LOG_SCHEMA).json(f"{root}/_log").select(F.explode("cells").alias("c"))
    commits = log.select(*facts, "c.units", "c.ok", F.lit(None).cast("int").alias("done_rank"))
    marks = spark.readStream.option("pathGlobFilter", "shard-*.done").text(f"{root}/completions")
    rank = F.regexp_extract(F.col("_metadata.file_name"), r"^shard-(\d+)\.done$", 1).cast("int")
    none = F.lit(0).cast("bigint")
    return commits.unionByName(marks.select(*facts, none.alias("units"), none.alias("ok"), rank.alias("done_rank")))


class RunState(StatefulProcessor):
    """Totals of one run; its final row once all shards are done."""

    def __init__(self, silence: float):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "units bigint, ok bigint, world int")
        self.done = handle.getMapState("done", "rank int", "at bigint")
        self.over = handle.getValueState("over", "final boolean")

    def _row(self, run: str, stalled: bool, final: bool) -> pd.DataFrame:
        units, ok, world = self.totals.get()
        ranks = sum(1 for _ in self.done.keys())
        return pd.DataFrame([{"run": run, "rows_ok": ok, "rows_failed": units - ok, "shards_done": ranks, "world": world,
                              "stalled": stalled, "final": final}])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.over.exists():      # a commit or marker that was written again
            return
        units, ok, world = self.totals.get() if self.totals.exists() else (0, 0, None)
        for batch in rows:
            units, ok = units + int(batch["units"].sum()), ok + int(batch["ok"].sum())
            if world is None and batch["world"].notna().any():
                world = int(batch["world"].dropna().iloc[0])
            for rank in batch["done_rank"].dropna().unique():
                self.done.updateValue((int(rank),), (1,))
        self.totals.update((units, ok, world))
        yield self._row(key[0], False, False)
        now = timerValues.getCurrentProcessingTimeInMs()
        # A marker may be listed just before the log entry that was written ahead of it; the next
        # stream batch has seen both, and only there the run ends.
        self._wake(now + 1 if self._complete() else now + int(self.silence * 1000))

    def _complete(self) -> bool:
        world = self.totals.get()[2]
        return world is not None and sum(1 for _ in self.done.keys()) >= world

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.over.exists() or not self.totals.exists():
            return
        final = self._complete()
        yield self._row(key[0], not final, final)
        if final:
            self.over.update((True,))
            self.totals.clear()
            self.done.clear()
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.silence * 1000))

    def close(self) -> None:
        pass


@dataclass
class Watch:
    """A query that ends by itself; ``final`` holds the final row of each run that is done."""

    query: StreamingQuery | None
    runs: set[str]
    final: dict[str, dict] = field(default_factory=dict)
    changes: list[dict] = field(default_factory=list)

    def wait(self, timeout: float | None = None) -> bool:
        """Until every run is done; False when the time is over before that."""
        end = None if timeout is None else time.monotonic() + timeout
        while self.runs - set(self.final):
            if self.query.awaitTermination(1):
                return not self.runs - set(self.final)
            if end is not None and time.monotonic() > end:
                return False
        self.query.stop()
        return True


KEPT_CHANGES = 1_000


def until_done(spark: SparkSession, outputs: list[str], checkpoint: str, silence: float = SILENCE,
               trigger: dict | None = None, on_change=None) -> Watch:
    """Follow runs until all of them are done. Their records must have been written.

    ``on_change`` gets each row as a dict; the handle keeps the last KEPT_CHANGES of them. A row stands for
    a run whose totals changed in a stream batch, so few reach the driver.
    """
    use_disk_state(spark)
    found = reduce(DataFrame.unionByName, [events(spark, o) for o in outputs])
    changed = found.groupBy("run").transformWithStateInPandas(
        RunState(silence), OUT, outputMode="Update", timeMode="ProcessingTime")
    watch = Watch(None, {o.rstrip("/").rsplit("/", 1)[-1] for o in outputs})

    def emit(batch: DataFrame, batch_id: int) -> None:
        for row in batch.toLocalIterator():      # one row for each run that changed
            fact = row.asDict()
            watch.changes = [*watch.changes[1 - KEPT_CHANGES:], fact]
            if on_change:
                on_change(fact)
            if fact["final"]:
                watch.final[fact["run"]] = fact

    watch.query = (changed.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", checkpoint)
                   .trigger(**(trigger or {"processingTime": "1 second"})).start())
    return watch
