"""Query of the near-duplicate operator, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import hyperminhash
from .tables import table


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hyperminhash.near_duplicates(docs, percent=85).drop("node")


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), listed AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM worded
), folded AS (
  SELECT min(doc_id) AS node, list_sort(s) AS s FROM listed WHERE len(s) > 0 GROUP BY list_sort(s)
), items AS (
  SELECT node, len(s) AS n, unnest(s) AS shingle FROM folded
), links AS (
  SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT node, node AS root FROM folded
  UNION
  SELECT links.a, reach.root FROM reach JOIN links ON links.b = reach.node
), groups AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT l.doc_id, len(l.s)::BIGINT AS n_shingles, coalesce(g.root, l.doc_id) AS component_id,
       coalesce(g.root, l.doc_id) = l.doc_id AS kept
FROM listed l LEFT JOIN folded f ON list_sort(l.s) = f.s LEFT JOIN groups g ON g.node = f.node
"""

QUERIES = {"op9_hyperminhash": (op9_hyperminhash, SQL)}
