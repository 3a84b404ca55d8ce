"""Query of the mixing operator, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .tables import table


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixing_plan(docs).select(
        "doc_id", F.col(mixing.SIZE).alias("size"), F.col(mixing.SOURCE_SIZE).alias("source_size"),
        F.col(mixing.TARGET).alias("target"), mixing.taken().alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents
), ranked AS (
  SELECT source, total, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight
  FROM (SELECT source, sum(size)::BIGINT AS total FROM sized GROUP BY source)
), ordered AS (
  SELECT *, (sum(total) OVER ())::BIGINT AS whole,
         coalesce(sum(2 * total) OVER before, 0)::BIGINT AS caps_before,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS weight_left
  FROM ranked
  WINDOW before AS (ORDER BY total * 6 / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), clamped AS (
  SELECT *, (3 * whole - 2 * caps_before)::HUGEINT * weight > (2 * total)::HUGEINT * 2 * weight_left AS full_up
  FROM ordered
), rest AS (
  SELECT (max(3 * whole) - 2 * coalesce(sum(2 * total) FILTER (full_up), 0))::BIGINT AS halves,
         (sum(weight) FILTER (NOT full_up))::BIGINT AS open_weight FROM clamped
), targets AS (
  SELECT source, total,
         CASE WHEN full_up THEN (2 * total)::DOUBLE
              ELSE (halves * weight)::DOUBLE / (2 * open_weight)::DOUBLE END AS target
  FROM clamped, rest
), goals AS (
  SELECT source, total, target, floor(target + 0.5)::BIGINT AS goal FROM targets
), shares AS (
  SELECT source, total, target, CASE WHEN total > 0 THEN goal // total ELSE 0 END AS repeats,
         CASE WHEN total > 0 THEN goal % total ELSE 0 END AS rest FROM goals
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, size, doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_it
  FROM sized
)
SELECT p.doc_id, p.size, s.total AS source_size, s.target,
       (s.repeats * p.size + least(greatest(s.rest - p.before_it, 0), p.size))::BIGINT AS taken
FROM placed p JOIN shares s ON p.source IS NOT DISTINCT FROM s.source
"""

QUERIES = {"op8_mixing": (op8_mixing, SQL)}
