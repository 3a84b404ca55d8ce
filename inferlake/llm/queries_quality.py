"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality
from .tables import table


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.quality(docs, keep=["doc_id"]).withColumnsRenamed({
        "QR_words": "n_words", "QR_word_chars": "word_chars", "QR_symbols": "n_symbols",
        "QR_dup_lines": "n_dup_lines", "QR_repeat_words": "n_repeat_words",
        "QR_class_distance": "class_distance", "QR_common_distance": "common_distance",
        "QR_base_failed": "base_failed", "QR_kept": "kept"})


QUERIES = {"op10_quality_rules": (op10_quality_rules, None)}
