"""Query of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam
from .tables import table


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.matches(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": (op4_decontamination, None)}
