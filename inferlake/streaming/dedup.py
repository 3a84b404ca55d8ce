"""Identical contents of a stream are passed on once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferlake.functions.ids import content_id
from inferlake.session import use_disk_state


WAYS = 16   # tasks that share the copies of one content


def dedup_stream(stream: DataFrame, column: str, time_column: str | None = None,
                 delay: str = "1 day") -> DataFrame:
    """``stream`` plus row_id, first occurrence of each content.

    A stream has no map-side folding, so the copies of a content are first reduced in
    WAYS groups, chosen by the other columns, and then to one. The state holds ids only.
    With a time column the ids older than ``delay`` leave the state, and a copy that
    comes later than that passes again.
    """
    use_disk_state(stream.sparkSession)
    others = [c for c in stream.columns if c != column]
    keyed = stream.withColumn("row_id", content_id(F.col(column)))
    if time_column is not None:
        keyed = keyed.withWatermark(time_column, delay)
    steps = [["row_id"]]
    if others:
        keyed = keyed.withColumn("_way", F.pmod(F.xxhash64(*others), F.lit(WAYS)))
        steps.insert(0, ["row_id", "_way"])
    for key in steps:
        keyed = (keyed.dropDuplicates(key) if time_column is None
                 else keyed.dropDuplicatesWithinWatermark(key))
    return keyed.drop("_way")
