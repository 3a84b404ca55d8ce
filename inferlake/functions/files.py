"""What a file in an output folder is, read from its relative path alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed file-name formats of the storage contract. A part or a sidecar may be one
# file or a folder of files that Spark wrote under the same name.
PART = r"^(part-[^/]+\.parquet)(?:/|$)"
SIDECAR = r"^_manifest/ids-(part-[^/]+\.parquet)(?:/|$)"
MARKER = r"^completions/shard-(\d+)\.done$"
STATS = r"^completions/stats-(\d+)\.json$"
TELEMETRY = r"^telemetry-shard(\d+)-(\d+)\.jsonl$"
RUN_RECORD = r"^run\.json$"


def file_kind(rel_path: Column) -> Column:
    """struct(kind, part, rank, epoch); unknown files have kind ``other``."""
    kinds = [("part", PART), ("manifest", SIDECAR), ("marker", MARKER),
             ("stats", STATS), ("telemetry", TELEMETRY), ("run_record", RUN_RECORD)]
    kind = F.lit("other")
    for name, pattern in reversed(kinds):
        kind = F.when(rel_path.rlike(pattern), F.lit(name)).otherwise(kind)

    def number(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(rel_path, pattern, group), F.lit("")).cast("bigint")

    part = F.nullif(F.coalesce(
        F.nullif(F.regexp_extract(rel_path, PART, 1), F.lit("")),
        F.regexp_extract(rel_path, SIDECAR, 1)), F.lit(""))
    rank = F.coalesce(number(MARKER, 1), number(STATS, 1), number(TELEMETRY, 1)).cast("int")
    return F.struct(kind.alias("kind"), part.alias("part"), rank.alias("rank"),
                    number(TELEMETRY, 2).alias("epoch"))
