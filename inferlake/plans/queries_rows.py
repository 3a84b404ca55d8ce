"""Registered queries: sources, text, ids, batches, profile, healing, sinks."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import functions as F

from inferlake.functions import ids, requests, sizing
from inferlake.functions.text import WHITESPACE, clean_text
from inferlake.operators import dedup, healing, profile, resume
from inferlake.operators.batching import micro_batch
from inferlake.operators.rowindex import build_index
from inferlake.operators.sketches import RELATIVE_ERROR
from inferlake.plans import profiles
from inferlake.session import shared_path
from inferlake.sources import pages as page_source
from inferlake.sources import sinks, tables
from inferlake.sources.storage import absolute, qualified, write_text

BATCH, WORLD = 64, 4

SQL_BLANKS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
SQL_CLEAN = f"trim(coalesce(text, ''), {SQL_BLANKS})"
TRUNCATED = 1200   # the one query that truncates
SQL_CLEANED = f"""cleaned AS (
  SELECT doc_id, {SQL_CLEAN} AS text FROM documents WHERE {SQL_CLEAN} <> '')"""
SQL_BATCHED = f"""{SQL_CLEANED},
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM cleaned),
batched AS (
  SELECT idx // {BATCH} AS batch_no, 'b-' || min(doc_id) AS row_id, count(*) AS n_texts,
         list(text ORDER BY idx) AS texts
  FROM numbered GROUP BY idx // {BATCH})"""
SQL_ROW_ID = "coalesce(sha256(text), 'null')"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def source_scan(spark, sf_dir):
    return tables.scan(documents(spark, sf_dir), ["doc_id", "text"])


def source_limit(spark, sf_dir):
    return tables.first_rows(documents(spark, sf_dir).select("doc_id", "n_chars"), "doc_id", 500)


def layout(spark, sf_dir):
    return tables.layout(documents(spark, sf_dir), "source", "lang", "doc_id")


def layout_choice(spark, sf_dir):
    return tables.layout_choice(layout(spark, sf_dir))


def row_counts(spark, sf_dir):
    return tables.row_counts(documents(spark, sf_dir), "source", "lang")


def cleaned(spark, sf_dir):
    return clean_text(documents(spark, sf_dir).select("doc_id", "text"), "text")


def clean_text_query(spark, sf_dir):
    kept = clean_text(documents(spark, sf_dir).select("doc_id", "text"), "text", TRUNCATED)
    return kept.withColumn("kept_chars", F.length("text").cast("bigint"))


def content_id(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", ids.content_id(F.col("text")).alias("row_id"))


def content_dedup(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return dedup.content_dedup(rows, "text", "doc_id").select(
        "row_id", "doc_id", "n_copies", "text")


def dense_index(spark, sf_dir):
    index = build_index(cleaned(spark, sf_dir), "doc_id")
    return index.attach(cleaned(spark, sf_dir).select("doc_id")).select("doc_id", "idx")


def shard_select(spark, sf_dir):
    return dense_index(spark, sf_dir).withColumn("rank", ids.shard_rank(F.col("idx"), WORLD))


def batches(spark, sf_dir):
    return micro_batch(cleaned(spark, sf_dir), "doc_id", "text", BATCH)


def micro_batch_query(spark, sf_dir):
    return batches(spark, sf_dir).select(
        "batch_no", "row_id", F.posexplode("texts").alias("pos", "text"))


def embed_request(spark, sf_dir):
    return batches(spark, sf_dir).select(
        "row_id", requests.embedding_request("hash-embedder", F.col("texts")).alias("request"))


def expected_rows(spark, sf_dir):
    limit = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 50)
    size = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 200)
    batch = F.when(F.col("o_orderstatus") == "O", 1).otherwise(BATCH)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", sizing.expected_items(limit, size).alias("expected_items"),
        sizing.expected_rows(limit, size, batch).alias("expected_rows"))


def page_resize(spark, sf_dir):
    size = sizing.resize_plan(F.length("html"), (F.col("page_id") + 1).cast("int"), 1540)
    return (table(spark, sf_dir, "pages").select("page_id", size.alias("s"))
            .select("page_id", F.col("s.width").cast("bigint").alias("width"),
                    F.col("s.height").cast("bigint").alias("height")))


def column_profile(spark, sf_dir):
    return profile.column_profile(documents(spark, sf_dir))


def conversation_profile(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "conversations"))


def profile_sketch(spark, sf_dir):
    """Profile by split from kept sketches: half of the documents, then the other half as new files. The
    estimate of distinct values is held against their exact number."""
    docs = documents(spark, sf_dir)
    root, store = shared_path(spark, "grown"), shared_path(spark, "profile")
    for half in (0, 1):
        docs.where(F.pmod("doc_id", F.lit(2)) == half).write.mode("append").parquet(root)
        profiles.update_profile(spark, spark.read.parquet(root), store, by=["source"])
    kept = profiles.kept_profile(spark, spark.read.parquet(root), store, by_split=True)
    values = F.struct(F.lit("text").alias("name"), F.coalesce("text", F.lit("")).alias("value"))
    langs = F.struct(F.lit("lang").alias("name"), F.coalesce("lang", F.lit("")).alias("value"))
    exact = (docs.select(F.col("source").alias("split"), F.inline(F.array(values, langs)))
             .groupBy("split", "name").agg(F.count_distinct("value").alias("exact")))
    off = F.abs(F.col("n_distinct") - F.col("exact"))
    return (kept.withColumnRenamed("source", "split").join(exact, ["split", "name"])
            .select("split", "ordinal", "name", "avg_len", "n_rows", F.col("exact").alias("n_distinct"),
                    (off <= F.ceil(F.col("exact") * RELATIVE_ERROR)).alias("within_error")))


def text_column_choice(spark, sf_dir):
    return profile.text_column_choice(profile.column_profile(table(spark, sf_dir, "pages")))


def resume_pending(spark, sf_dir):
    work = documents(spark, sf_dir).select("doc_id", "text")
    return resume.pending(work, table(spark, sf_dir, "labels"), "doc_id")


def attempts(spark, sf_dir):
    """Documents as results of three attempts: the first fails for every seventh, the
    second fails for every fourteenth, the third never gets past every forty-ninth."""
    docs = documents(spark, sf_dir).select(
        F.col("doc_id"), F.col("doc_id").cast("string").alias("row_id"), "text")
    first = docs.select("row_id", "text", F.lit(1).cast("bigint").alias("attempt"),
                        F.when(F.col("doc_id") % 7 == 0, "timeout").alias("error"))
    second = docs.where("doc_id % 7 = 0").select(
        "row_id", F.concat(F.col("text"), F.lit("!")).alias("text"),
        F.lit(2).cast("bigint").alias("attempt"),
        F.when(F.col("doc_id") % 14 == 0, "refused").alias("error"))
    third = docs.where("doc_id % 14 = 0").select(
        "row_id", F.concat(F.col("text"), F.lit("?")).alias("text"),
        F.lit(3).cast("bigint").alias("attempt"),
        F.when(F.col("doc_id") % 49 == 0, "refused").alias("error"))
    return first, second, third


SQL_ATTEMPTS = """attempts AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS row_id, text, 1 AS attempt,
         CASE WHEN doc_id % 7 = 0 THEN 'timeout' END AS error FROM documents
  UNION ALL
  SELECT doc_id, CAST(doc_id AS VARCHAR), text || '!', 2,
         CASE WHEN doc_id % 14 = 0 THEN 'refused' END FROM documents WHERE doc_id % 7 = 0
  UNION ALL
  SELECT doc_id, CAST(doc_id AS VARCHAR), text || '?', 3,
         CASE WHEN doc_id % 49 = 0 THEN 'refused' END FROM documents WHERE doc_id % 14 = 0),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY row_id
                               ORDER BY error IS NOT NULL, attempt DESC) AS pick FROM attempts)"""


def healed_read(spark, sf_dir):
    first, second, third = attempts(spark, sf_dir)
    return healing.healed(first.unionByName(second).unionByName(third),
                          include_errors=True).select("row_id", "attempt", "error", "text")


def committed_run(spark, sf_dir):
    """The attempts above as three commits of one run, all shards done."""
    root = shared_path(spark, "committed")
    for seq, records in enumerate(attempts(spark, sf_dir)):
        sinks.commit(records.withColumn("rank", F.lit(0)), root, sinks.part_name(seq + 1, seq))
    write_text(spark, f"{root}/completions/shard-0.done", "done")
    return root


def write_read_parts(spark, sf_dir):
    root = shared_path(spark, "parts")
    rows = documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("row_id"), "text", "n_chars")
    sinks.write_part(rows, root, sinks.part_name(1, 0), rows_per_file=100)
    return sinks.read_parts(spark, root)


def done_ids(spark, sf_dir):
    return sinks.done_ids(spark, committed_run(spark, sf_dir)).select("row_id").distinct()


def manifest_view(spark, sf_dir):
    root = committed_run(spark, sf_dir)
    return sinks.read_manifest(spark, root).groupBy("attempt", "ok").agg(
        F.count(F.lit(1)).alias("n"))


def publish(spark, sf_dir):
    from inferlake.plans.runs import publish as publish_run

    root = committed_run(spark, sf_dir)
    target = publish_run(spark, root, shared_path(spark, "published"))
    return spark.read.parquet(target).select("row_id", "attempt", "text")


def _page_writer(root):
    """Rows (page_id, value) in order of their ids to a file for each id; a task that is tried again writes the same."""
    def run(batches):
        known, written = None, 0
        for batch in batches:
            for page, value in zip(*(c.to_pylist() for c in batch.columns)):
                folder = f"{root}/page_id={'__HIVE_DEFAULT_PARTITION__' if page is None else page}"
                again, known = written and folder == known, folder
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/page.txt", "ab" if again else "wb") as out:
                    out.write((value or "").encode() + b"\n")
                written += not again
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["files"])
    return run


def page_folder(spark, sf_dir):
    """One file per row of ``pages``.

    Hadoop's local file system starts a process for each file and folder that it makes, to set its mode, so on a
    shared local folder the tasks write the files themselves; elsewhere Spark's writer does.
    """
    root = shared_path(spark, "pages")
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("value")).repartition("page_id")
    scheme = urlsplit(qualified(spark, root)).scheme
    if scheme == "file":
        written = pages.sortWithinPartitions("page_id").mapInArrow(_page_writer(absolute(spark, root)), "files bigint")
        written.agg(F.sum("files")).collect()
    else:
        pages.write.partitionBy("page_id").text(root)
    return root


def page_files(spark, sf_dir):
    root = page_folder(spark, sf_dir)
    listed = page_source.list_pages(spark, f"{root}/**/*.txt", "content")
    text = F.decode(F.col("content"), "UTF-8")
    html = F.substring(text, F.lit(1), F.length(text) - 1)   # the writer ends the file with \n
    page = F.regexp_extract("row_id", r"page_id=(\d+)/", 1).cast("bigint")
    return listed.select(page.alias("page_id"), F.length(html).cast("bigint").alias("n_chars"),
                         F.sha2(html, 256).alias("sha"))


_PROFILE_SQL = """SELECT {i} AS ordinal, '{c}' AS name,
  round_even(sum(length(coalesce({c}, ''))) / count(*), 1) AS avg_len,
  round_even(count(DISTINCT coalesce({c}, '')) / count(*), 2) AS uniq FROM {t}"""


def _profile_sql(t, *columns):
    return " UNION ALL ".join(
        _PROFILE_SQL.format(i=i, c=c, t=t) for i, c in enumerate(columns))


_SKETCH_SQL = """SELECT source AS split, {i} AS ordinal, '{c}' AS name,
  round_even(sum(length(coalesce({c}, ''))) / count(*), 1) AS avg_len, count(*) AS n_rows,
  count(DISTINCT coalesce({c}, '')) AS n_distinct, TRUE AS within_error FROM documents GROUP BY source"""

SQL_LAYOUT = """SELECT source AS config, lang AS split, min(doc_id) AS ordinal
  FROM documents GROUP BY source, lang"""

QUERIES = {
    "source_scan": (source_scan, "SELECT doc_id, text FROM documents"),
    "source_limit": (source_limit,
                     "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 500"),
    "layout": (layout, SQL_LAYOUT),
    "layout_choice": (layout_choice, f"""WITH pairs AS ({SQL_LAYOUT}),
        c AS (SELECT config FROM pairs ORDER BY config <> 'default', ordinal LIMIT 1),
        s AS (SELECT p.config, p.split FROM pairs p JOIN c USING (config)
              ORDER BY p.split <> 'train', p.ordinal LIMIT 1)
        SELECT config, split, 'detected' AS source FROM s"""),
    "row_counts": (row_counts, """SELECT source AS config, lang AS split, count(*) AS n_rows
        FROM documents GROUP BY source, lang"""),
    "clean_text": (clean_text_query, f"""WITH {SQL_CLEANED}
        SELECT doc_id, substr(text, 1, {TRUNCATED}) AS text,
               length(substr(text, 1, {TRUNCATED})) AS kept_chars FROM cleaned"""),
    "content_id": (content_id, f"SELECT doc_id, {SQL_ROW_ID} AS row_id FROM documents"),
    "content_dedup": (content_dedup, f"""SELECT {SQL_ROW_ID} AS row_id, min(doc_id) AS doc_id,
        count(*) AS n_copies, text FROM documents GROUP BY text"""),
    "dense_index": (dense_index, f"""WITH {SQL_CLEANED}
        SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM cleaned"""),
    "shard_select": (shard_select, f"""WITH {SQL_CLEANED}, n AS (
        SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM cleaned)
        SELECT doc_id, idx, CAST(idx % {WORLD} AS INTEGER) AS rank FROM n"""),
    "micro_batch": (micro_batch_query, f"""WITH {SQL_BATCHED}
        SELECT b.batch_no, b.row_id, CAST(n.idx % {BATCH} AS INTEGER) AS pos, n.text
        FROM numbered n JOIN batched b ON n.idx // {BATCH} = b.batch_no"""),
    "embed_request": (embed_request, f"""WITH {SQL_BATCHED} SELECT row_id,
        CAST(to_json({{'model': 'hash-embedder', 'input': texts}}) AS VARCHAR) AS request
        FROM batched"""),
    "expected_rows": (expected_rows, f"""WITH x AS (SELECT o_orderkey,
        nullif(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 50 END, 0) AS a,
        nullif(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 200 END, 0) AS b,
        CASE WHEN o_orderstatus = 'O' THEN 1 ELSE {BATCH} END AS batch FROM orders)
        SELECT o_orderkey, least(a, b) AS expected_items,
               CAST(ceil(least(a, b) / batch) AS BIGINT) AS expected_rows FROM x"""),
    "page_resize": (page_resize, """WITH x AS (SELECT page_id, length(html) AS w,
        page_id + 1 AS h, 1540.0::DOUBLE / greatest(length(html), page_id + 1) AS scale FROM pages)
        SELECT page_id,
          CAST(CASE WHEN greatest(w, h) = 1540 THEN w ELSE round_even(w * scale, 0) END AS BIGINT)
            AS width,
          CAST(CASE WHEN greatest(w, h) = 1540 THEN h ELSE round_even(h * scale, 0) END AS BIGINT)
            AS height FROM x"""),
    "column_profile": (column_profile, _profile_sql("documents", "text", "lang", "source")),
    "conversation_profile": (conversation_profile, _profile_sql("conversations", "role", "text")),
    "profile_sketch": (profile_sketch, " UNION ALL ".join(
        _SKETCH_SQL.format(i=i, c=c) for i, c in enumerate(("text", "lang")))),
    "text_column_choice": (text_column_choice, f"""WITH p AS (
        {_profile_sql("pages", "url", "html")})
        SELECT name AS "column", 'detected' AS source FROM p
        ORDER BY name <> 'text', uniq < 0.3, avg_len DESC, ordinal LIMIT 1"""),
    "resume_pending": (resume_pending, """SELECT doc_id, text FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""),
    "healed_read": (healed_read, f"""WITH {SQL_ATTEMPTS} SELECT row_id,
        CAST(attempt AS BIGINT) AS attempt, error, text
        FROM picked WHERE pick = 1 AND error IS NULL
        UNION ALL SELECT row_id, CAST(attempt AS BIGINT), error, text
        FROM picked WHERE pick = 1 AND error IS NOT NULL"""),
    "write_read_parts": (write_read_parts, """SELECT CAST(doc_id AS VARCHAR) AS row_id, text,
        n_chars FROM documents"""),
    "done_ids": (done_ids, f"""WITH {SQL_ATTEMPTS}
        SELECT DISTINCT row_id FROM attempts WHERE error IS NULL"""),
    "manifest_view": (manifest_view, f"""WITH {SQL_ATTEMPTS}
        SELECT CAST(attempt AS BIGINT) AS attempt, error IS NULL AS ok, count(*) AS n
        FROM attempts GROUP BY ALL"""),
    "publish": (publish, f"""WITH {SQL_ATTEMPTS} SELECT row_id,
        CAST(attempt AS BIGINT) AS attempt, text
        FROM picked WHERE pick = 1 AND error IS NULL"""),
    "page_files": (page_files, """SELECT page_id, length(html) AS n_chars,
        sha256(html) AS sha FROM pages"""),
}
