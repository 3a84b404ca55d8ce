"""Query of the token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import huffman
from .tables import table

TOKENIZER, END = "word_bpe_49k.json", 1


def op6_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return huffman.written_and_read(docs, public_tokenizers.path(TOKENIZER), END)


QUERIES = {"op6_huffman_tokens": (op6_huffman_tokens, None)}
