"""Registered queries: requests, responses, model application, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from inferlake.functions import requests, responses
from inferlake.models import build
from inferlake.operators import dedup, inference
from inferlake.operators.batching import explode_batches, micro_batch
from inferlake.plans import runs
from inferlake.plans.queries_rows import (
    BATCH, SQL_BATCHED, SQL_CLEANED, SQL_ROW_ID, WORLD, batches, cleaned, documents,
    page_folder, table,
)
from inferlake.session import shared_path
from inferlake.sources import tables
from inferlake.sources import sinks
from inferlake.spec import JobSpec
from inferlake.streaming import inference as stream_inference
from inferlake.streaming import progress as stream_progress_ops
from inferlake.streaming.dedup import dedup_stream

EMBEDDER = "hash-embedder"
FAULT_BATCH = 8
FAULTS = {"raise_on": "zz", "short_on": "License"}


def chat_request(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", requests.chat_request("echo", F.col("text")).alias("request"))


def page_request(spark, sf_dir):
    page = F.encode("html", "UTF-8")
    return table(spark, sf_dir, "pages").select(
        "page_id", requests.page_request("tag-stripper", page, "Read this page.").alias("request"))


def embed_parse(spark, sf_dir):
    """Every row of ``embeddings`` as a response body; every seventh carries one vector too
    many and every eleventh is cut off."""
    vector = F.struct("embedding")
    data = F.when(F.col("vec_id") % 7 == 0, F.array(vector, vector)).otherwise(F.array(vector))
    usage = F.when(F.col("vec_id") % 2 == 0, F.struct(F.col("vec_id").alias("prompt_tokens")))
    body = F.to_json(F.struct(data.alias("data"), usage.alias("usage")))
    body = F.when(F.col("vec_id") % 11 == 0, F.substring(body, 1, 9)).otherwise(body)
    texts = F.array(F.col("vec_id").cast("string"))
    parsed = table(spark, sf_dir, "embeddings").select(
        "vec_id", responses.parse_embedding(texts, body).alias("r"))
    return parsed.select(
        "vec_id", "r.n_texts", "r.prompt_tokens", "r.error",
        F.posexplode_outer(F.get("r.embeddings", 0)).alias("pos", "value")).withColumn(
        "value", F.col("value").cast("double"))


SQL_EMBED_PARSE = """
WITH x AS (
  SELECT vec_id, embedding, CASE WHEN vec_id % 11 = 0 THEN 'response has no data'
    WHEN vec_id % 7 = 0 THEN '2 vectors for 1 texts' END AS error FROM embeddings),
y AS (SELECT vec_id, error, unnest(embedding) AS value,
             unnest(range(len(embedding))) AS pos FROM x WHERE error IS NULL)
SELECT vec_id, 1 AS n_texts, CASE WHEN vec_id % 2 = 0 THEN vec_id END AS prompt_tokens, error,
       CAST(pos AS INTEGER) AS pos, CAST(value AS DOUBLE) AS value FROM y
UNION ALL
SELECT vec_id, NULL, NULL, error, NULL, NULL FROM x WHERE error IS NOT NULL"""


def _chat_body(text, key):
    """A chat body; every fifth has no choice, every third no usage."""
    message = F.struct(F.struct(text.alias("content")).alias("message"))
    choices = F.when(key % 5 != 0, F.array(message)).otherwise(F.array().cast(
        "array<struct<message:struct<content:string>>>"))
    usage = F.when(key % 3 != 0, F.struct(F.length(text).alias("prompt_tokens"),
                                          key.alias("completion_tokens")))
    return F.to_json(F.struct(choices.alias("choices"), usage.alias("usage")))


def chat_parse(spark, sf_dir):
    body = _chat_body(F.col("text"), F.col("conv_id"))
    return (table(spark, sf_dir, "conversations")
            .select("conv_id", "turn", responses.parse_chat(body).alias("r"))
            .select("conv_id", "turn", "r.*"))


def page_parse(spark, sf_dir):
    body = _chat_body(F.col("html"), F.col("page_id"))
    return (table(spark, sf_dir, "pages")
            .select("page_id", responses.parse_page("tag-stripper", body).alias("r"))
            .select("page_id", "r.*"))


SQL_CHAT_FIELDS = """CASE WHEN {k} % 5 <> 0 THEN {t} END AS {name},
    CASE WHEN {k} % 3 <> 0 THEN length({t}) END AS prompt_tokens,
    CASE WHEN {k} % 3 <> 0 THEN {k} END AS completion_tokens,
    CASE WHEN {k} % 5 = 0 OR {t} IS NULL THEN 'response has no message content' END AS error"""


def embed_docs(spark, sf_dir):
    """Documents to vectors, end to end: one row per document and dimension."""
    scored = inference.embed_units(batches(spark, sf_dir), EMBEDDER, build(EMBEDDER))
    return (explode_batches(scored, "embeddings")
            .select(F.col("member_id").alias("doc_id"),
                    F.posexplode("embeddings").alias("dim", "value"))
            .withColumn("value", F.col("value").cast("double")))


SQL_EMBED_DOCS = f"""
WITH {SQL_CLEANED},
tokens AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM cleaned),
counts AS (SELECT doc_id, CAST('0x' || substr(md5(token), 1, 1) AS INTEGER) AS dim, count(*) AS n
           FROM tokens WHERE token <> '' GROUP BY ALL),
dims AS (SELECT CAST(unnest(range(16)) AS INTEGER) AS dim)
SELECT c.doc_id, d.dim, CAST(coalesce(n, 0) AS DOUBLE) AS value
FROM cleaned c CROSS JOIN dims d LEFT JOIN counts k ON k.doc_id = c.doc_id AND k.dim = d.dim"""


def embed_errors(spark, sf_dir):
    """A model that refuses some requests and loses a vector in others."""
    units = micro_batch(cleaned(spark, sf_dir), "doc_id", "text", FAULT_BATCH)
    scored = inference.embed_units(units, "faulty", build("faulty", FAULTS))
    return scored.select("row_id", "n_texts", "error")


SQL_EMBED_ERRORS = f"""
WITH {SQL_CLEANED}, n AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM cleaned),
b AS (SELECT 'b-' || min(doc_id) AS row_id, count(*) AS n,
             bool_or(contains(text, 'zz')) AS refused, bool_or(contains(text, 'License')) AS short
      FROM n GROUP BY idx // {FAULT_BATCH}),
e AS (SELECT row_id, n, CASE WHEN refused THEN 'RuntimeError: model refused the request'
      WHEN short THEN (n - 1) || ' vectors for ' || n || ' texts' END AS error FROM b)
SELECT row_id, CASE WHEN error IS NULL THEN CAST(n AS INTEGER) END AS n_texts, error FROM e"""


def _generation_plan(spark, sf_dir, output="unused"):
    spec = JobSpec(task="generation", dataset="documents", model="echo", output=output,
                   column="text", id_column="doc_id", world=WORLD)
    return runs.compile(spark, spec, source=documents(spark, sf_dir))


def generate_prompts(spark, sf_dir):
    plan = _generation_plan(spark, sf_dir)
    return plan.apply(plan.work()).select(
        "row_id", "rank", "n_copies", "response", "prompt_tokens", "completion_tokens", "error")


def generate_all_rows(spark, sf_dir):
    """Every source row with the answer to its prompt, copies included."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    plan = _generation_plan(spark, sf_dir)
    results = plan.apply(plan.work()).select("row_id", "response", "error")
    copies = dedup.distinct_contents(docs, "text", "doc_id").select("row_id", "n_copies")
    return dedup.attach_to_all_rows(docs, "text", "doc_id", results, copies,
                                    plan.spec.num_examples).select(
        "doc_id", "row_id", "response", "error")


SQL_GENERATE = f"""
WITH n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT {SQL_ROW_ID} AS row_id, CAST(min(idx) % {WORLD} AS INTEGER) AS rank,
       count(*) AS n_copies, 'echo: ' || text AS response, length(text) AS prompt_tokens,
       length(text) + 6 AS completion_tokens, CAST(NULL AS VARCHAR) AS error
FROM n GROUP BY text"""


def _generation_run(spark, sf_dir):
    return runs.launch(_generation_plan(spark, sf_dir, shared_path(spark, "generation-run")))


def run_status(spark, sf_dir):
    """Progress of a launched run, read back from its files."""
    found = _generation_run(spark, sf_dir).status()
    return found.progress.join(found.storage, "run").drop("run")


def run_shards(spark, sf_dir):
    """Shard stats, markers and telemetry of a launched run, read back from its files."""
    found = _generation_run(spark, sf_dir).status()
    ticks = found.telemetry.groupBy("rank").agg(F.sum("ok").alias("ticked_ok"))
    return found.shards.join(ticks, "rank", "left").select(
        "rank", "done", "stats.rows_total", "stats.rows_done_prior", "stats.rows_processed",
        "stats.rows_failed", "stats.rows_deduped", "stats.prompt_tokens",
        "stats.completion_tokens", "ticked_ok")


def pages_to_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.encode("html", "UTF-8").alias("content"))
    return inference.read_pages(pages, "content", "tag-stripper", build("tag-stripper")).select(
        "page_id", "markdown", "model", "prompt_tokens", "completion_tokens", "error")


SQL_MARKDOWN = "regexp_replace(html, '<[^>]*>', '', 'g')"


def _embedded_copies(spark, sf_dir, name, **options):
    """Runs without an id column: how often each content is among the results."""
    done = runs.embed(spark, f"{sf_dir}/documents.parquet", output=shared_path(spark, name), column="text",
                      world=WORLD, **options)
    texts = done.results().select(F.explode("texts").alias("text"))
    return texts.groupBy(F.sha2("text", 256).alias("content")).agg(F.count(F.lit(1)).alias("n_rows"))


def embed_no_ids(spark, sf_dir):
    return _embedded_copies(spark, sf_dir, "embed-no-ids")


def embed_no_ids_limit(spark, sf_dir):
    return _embedded_copies(spark, sf_dir, "embed-first-rows", limit=150)


def generate_no_ids_limit(spark, sf_dir):
    done = runs.generate(spark, f"{sf_dir}/documents.parquet", model="echo", output=shared_path(spark, "generate-first-rows"),
                         column="text", limit=150)
    return done.results().select("row_id", F.col("n_copies").cast("bigint").alias("n_copies"))


def source_limit_large(spark, sf_dir):
    """More rows than one task should merge."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return tables.first_rows(orders, "o_orderkey", 12_000)


def embed_run(spark, sf_dir):
    """A launched run over two shards, interrupted after the first wave, resumed and read."""
    output = shared_path(spark, "embed-run")
    # a quarter of the batches per commit
    wave_units = -(-documents(spark, sf_dir).count() // (4 * BATCH))
    options = dict(output=output, id_column="doc_id", column="text", world=2,
                   wave_units=wave_units)
    plan = runs.embed(spark, f"{sf_dir}/documents.parquet", launch=False, **options)
    work = plan.work().where("wave = 0")
    sinks.commit(plan.apply(work).withColumn("attempt", F.lit(0).cast("bigint")),
                 output, sinks.part_name(0, 0))
    run = runs.launch(plan)
    return run.results().select("row_id", "rank", "n_texts", "prompt_tokens",
                                (F.col("attempt") == 0).alias("from_first_attempt"))


SQL_EMBED_RUN = f"""WITH {SQL_BATCHED}
SELECT row_id, CAST(batch_no % 2 AS INTEGER) AS rank, CAST(n_texts AS INTEGER) AS n_texts,
       CAST(len(list_filter(string_split(array_to_string(texts, ' '), ' '), lambda t: t <> ''))
            AS BIGINT) AS prompt_tokens,
       batch_no < (SELECT ceil(count(*) / (4.0 * {BATCH})) FROM documents) AS from_first_attempt
FROM batched"""


def page_run(spark, sf_dir):
    """Page files under a glob to markdown, as a run with one commit per wave."""
    run = runs.ocr(spark, f"{page_folder(spark, sf_dir)}/**/*.txt", model="tag-stripper",
                   output=shared_path(spark, "page-run"), world=2, wave_units=2_000)
    return run.results().select(
        F.regexp_extract("row_id", r"page_id=(\d+)/", 1).cast("bigint").alias("page_id"),
        F.regexp_replace("markdown", r"\n\z", "").alias("markdown"), "error")


def _stream(spark, sf_dir, name):
    # a glob, since a file stream watches folders
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return (reader.option("maxBytesPerTrigger", 64 << 30)
            .parquet(f"{sf_dir}/{name}.parque[t]"))


def stream_dedup(spark, sf_dir):
    target = shared_path(spark, "stream-dedup")
    query = (dedup_stream(_stream(spark, sf_dir, "documents"), "text").select("row_id", "text")
             .writeStream.format("parquet").option("path", target)
             .option("checkpointLocation", shared_path(spark, "stream-checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(target)


def stream_generate(spark, sf_dir):
    output = shared_path(spark, "stream-generate")
    spec = JobSpec(task="generation", dataset="documents", model="echo", output=output)
    stream_inference.start(_stream(spark, sf_dir, "documents"), spec,
                           shared_path(spark, "stream-checkpoint")).awaitTermination()
    return sinks.read_healed(spark, output).select("row_id", "response")


def stream_embed(spark, sf_dir):
    output = shared_path(spark, "stream-embed")
    spec = JobSpec(task="embeddings", dataset="documents", model=EMBEDDER, output=output,
                   id_column="doc_id", batch=BATCH)
    stream_inference.start(_stream(spark, sf_dir, "documents"), spec,
                           shared_path(spark, "stream-checkpoint")).awaitTermination()
    members = explode_batches(sinks.read_healed(spark, output), "embeddings")
    tokens = F.aggregate("embeddings", F.lit(0.0).cast("float"), lambda acc, x: acc + x)
    return members.select(F.col("member_id").alias("doc_id"),
                          tokens.cast("bigint").alias("n_tokens"))


def stream_progress(spark, sf_dir):
    ticks = _stream(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.floor("value").cast("bigint").alias("ok"))
    target = shared_path(spark, "stream-progress")
    stream_progress_ops.start(ticks, target,
                              shared_path(spark, "stream-checkpoint")).awaitTermination()
    updates = spark.read.option("recursiveFileLookup", "true").parquet(target)
    return stream_progress_ops.latest(updates)


QUERIES = {
    "chat_request": (chat_request, """SELECT conv_id, turn,
        CAST(to_json({'model': 'echo', 'messages': [{'role': 'user', 'content': text}],
                      'max_tokens': 512, 'temperature': 0.7::DOUBLE}) AS VARCHAR) AS request
        FROM conversations"""),
    "page_request": (page_request, """SELECT page_id,
        '{"model":"tag-stripper","messages":[{"role":"user","content":'
        || '[{"type":"text","text":"Read this page."},{"type":"image_url","image_url":'
        || '{"url":"data:image/png;base64,' || to_base64(encode(html)) || '"}}]}],'
        || '"max_tokens":4096,"temperature":0.2,"top_p":0.9}' AS request FROM pages"""),
    "embed_parse": (embed_parse, SQL_EMBED_PARSE),
    "chat_parse": (chat_parse, "SELECT conv_id, turn, " + SQL_CHAT_FIELDS.format(
        k="conv_id", t="text", name="response") + " FROM conversations"),
    "page_parse": (page_parse, "SELECT page_id, 'tag-stripper' AS model, "
                   + SQL_CHAT_FIELDS.format(k="page_id", t="html", name="markdown")
                   + " FROM pages"),
    "embed_docs": (embed_docs, SQL_EMBED_DOCS),
    "embed_no_ids": (embed_no_ids, f"""WITH {SQL_CLEANED}
        SELECT sha256(text) AS content, count(*) AS n_rows FROM cleaned GROUP BY ALL"""),
    "embed_no_ids_limit": (embed_no_ids_limit, f"""WITH first_rows AS (
        SELECT * FROM documents ORDER BY doc_id LIMIT 150), {SQL_CLEANED.replace("FROM documents", "FROM first_rows")}
        SELECT sha256(text) AS content, count(*) AS n_rows FROM cleaned GROUP BY ALL"""),
    "generate_no_ids_limit": (generate_no_ids_limit, f"""WITH first_rows AS (
        SELECT * FROM documents ORDER BY doc_id LIMIT 150)
        SELECT {SQL_ROW_ID} AS row_id, count(*) AS n_copies FROM first_rows GROUP BY ALL"""),
    "source_limit_large": (source_limit_large, """SELECT o_orderkey, o_custkey FROM orders
        ORDER BY o_orderkey LIMIT 12000"""),
    "embed_errors": (embed_errors, SQL_EMBED_ERRORS),
    "generate_prompts": (generate_prompts, SQL_GENERATE),
    "run_status": (run_status, f"""WITH g AS ({SQL_GENERATE}), n AS (
        SELECT count(*) AS rows_ok, (SELECT count(*) FROM documents) AS total FROM g)
        SELECT rows_ok, CAST(0 AS BIGINT) AS rows_failed, total AS expected_rows,
               rows_ok::DOUBLE / total AS pct, true AS exact, 1 AS items_per_row,
               rows_ok AS items_ok, total AS expected_items, true AS has_run_json,
               CAST(1 AS BIGINT) AS parts, CAST(0 AS BIGINT) AS orphans, {WORLD} AS world,
               false AS world_inferred FROM n"""),
    "run_shards": (run_shards, f"""WITH g AS ({SQL_GENERATE})
        SELECT rank, true AS done, count(*) AS rows_total, CAST(0 AS BIGINT) AS rows_done_prior,
               count(*) AS rows_processed, CAST(0 AS BIGINT) AS rows_failed,
               CAST(sum(n_copies - 1) AS BIGINT) AS rows_deduped,
               CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
               CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
               count(*) AS ticked_ok FROM g GROUP BY rank"""),
    "generate_all_rows": (generate_all_rows, f"""SELECT doc_id, {SQL_ROW_ID} AS row_id,
        'echo: ' || text AS response, CAST(NULL AS VARCHAR) AS error FROM documents"""),
    "pages_to_text": (pages_to_text, f"""SELECT page_id, {SQL_MARKDOWN} AS markdown,
        'tag-stripper' AS model, length(html) AS prompt_tokens,
        length({SQL_MARKDOWN}) AS completion_tokens, CAST(NULL AS VARCHAR) AS error FROM pages"""),
    "embed_run": (embed_run, SQL_EMBED_RUN),
    "page_run": (page_run, f"""SELECT page_id, {SQL_MARKDOWN} AS markdown,
        CAST(NULL AS VARCHAR) AS error FROM pages"""),
    "stream_dedup": (stream_dedup,
                     f"SELECT DISTINCT {SQL_ROW_ID} AS row_id, text FROM documents"),
    "stream_generate": (stream_generate, f"""SELECT DISTINCT {SQL_ROW_ID} AS row_id,
        'echo: ' || text AS response FROM documents"""),
    "stream_embed": (stream_embed, f"""WITH {SQL_CLEANED} SELECT doc_id,
        len(list_filter(string_split(text, ' '), lambda t: t <> '')) AS n_tokens FROM cleaned"""),
    "stream_progress": (stream_progress, """SELECT event_type AS run,
        CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS rows_ok, count(*) AS ticks
        FROM events GROUP BY event_type"""),
}
