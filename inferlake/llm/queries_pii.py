"""Query of the pseudonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pseudonyms
from .tables import table

#: A key for the registered query; real ones are secret.
KEY = "registered-query"


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymise(docs, KEY)
    return out.select("doc_id", F.col("PII_text").alias("text"), pseudonyms.found_in_total().alias("n_values"),
                      *(F.col(f"PII_found.{k}").alias(f"n_{k}") for k in pseudonyms.KINDS))


QUERIES = {"op2_pseudonyms": (op2_pseudonyms, None)}
