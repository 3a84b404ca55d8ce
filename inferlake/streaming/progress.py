"""Live progress: totals per run, written again whenever new ticks arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inferlake.sources.sinks import MANIFEST_SCHEMA


def committed(spark: SparkSession, output: str) -> DataFrame:
    """Stream of finished units of a run, from the id sidecars that each commit adds."""
    ids = spark.readStream.schema(MANIFEST_SCHEMA).parquet(f"{output}/_manifest/ids-*.parquet")
    return ids.select(F.lit(output.rstrip("/").rsplit("/", 1)[-1]).alias("run"), "rank",
                      F.when(F.col("ok"), 1).otherwise(0).cast("bigint").alias("ok"))


def running_totals(ticks: DataFrame) -> DataFrame:
    """(run, rows_ok, ticks) of a stream of ticks; the state is one row per run."""
    return ticks.groupBy("run").agg(F.sum(F.coalesce("ok", F.lit(0))).alias("rows_ok"),
                                    F.count(F.lit(1)).alias("ticks"))


def start(ticks: DataFrame, target: str, checkpoint: str,
          trigger: dict | None = None) -> StreamingQuery:
    """Each stream batch appends the totals of the runs it changed."""

    def emit(changed: DataFrame, batch_id: int) -> None:
        (changed.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").parquet(f"{target}/update={batch_id:08d}"))

    return (running_totals(ticks).writeStream.outputMode("update").foreachBatch(emit)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def latest(updates: DataFrame) -> DataFrame:
    """The newest totals of each run."""
    newest = F.max_by(F.struct("rows_ok", "ticks"), "batch_id")
    return updates.groupBy("run").agg(newest.alias("n")).select("run", "n.*")
