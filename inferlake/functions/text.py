"""Text preparation as column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character Python's str.strip() removes; Spark's plain trim() knows only the space.
# None lies beyond the ideographic space, U+3000.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def stripped(text: Column) -> Column:
    """Null becomes "", then Unicode whitespace goes from both ends."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))


def clean_text(df: DataFrame, column: str, truncate: int | None = None) -> DataFrame:
    """Strip and drop empty rows; with ``truncate``, keep that many characters of each text."""
    # The null test is implied by the strip; stating it lets the scan skip null pages.
    kept = df.where(F.col(column).isNotNull() & (stripped(F.col(column)) != ""))
    whole = stripped(F.col(column))
    return kept.withColumn(column, whole if truncate is None else F.substring(whole, 1, truncate))
