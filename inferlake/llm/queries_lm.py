"""Query of the language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import katz
from .tables import table


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.katz_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, order=2)


QUERIES = {"op1_katz_scores": (op1_katz_scores, None)}
