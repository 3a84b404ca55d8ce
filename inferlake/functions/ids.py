"""Row identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(text: Column) -> Column:
    """Equal texts share an id. A null text has an id of its own, apart from ""."""
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


def path_below(path: Column, root: str) -> Column:
    """File path relative to the absolute folder ``root``, whatever scheme or host precedes it."""
    head = root.rstrip("/") + "/"
    return F.substring(path, F.locate(head, path) + F.lit(len(head)), F.length(path))


def batch_id(first_member: Column) -> Column:
    return F.concat(F.lit("b-"), first_member.cast("string"))


def shard_rank(index: Column, world: int) -> Column:
    """Strided shards: item i belongs to rank i mod world."""
    return F.pmod(index, F.lit(world)).cast("int")
