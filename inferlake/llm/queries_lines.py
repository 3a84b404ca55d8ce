"""Query of the line templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import templates
from .tables import table


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return templates.drop_templates(docs).withColumnRenamed("kept", "text")


QUERIES = {"op7_line_templates": (op7_line_templates, None)}
