"""Model response bodies parsed by ``from_json``; a bad body becomes an error, never a success."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMBEDDING_BODY = ("data array<struct<embedding:array<float>>>, "
                  "usage struct<prompt_tokens:bigint>")
CHAT_BODY = ("choices array<struct<message:struct<content:string>>>, "
             "usage struct<prompt_tokens:bigint,completion_tokens:bigint>")


def parse_embedding(texts: Column, body: Column) -> Column:
    """struct(texts, embeddings, n_texts, prompt_tokens, error)."""
    doc = F.from_json(body, EMBEDDING_BODY)
    want, got = F.size(texts), F.coalesce(F.size(doc["data"]), F.lit(-1))
    error = (F.when(got < 0, F.lit("response has no data"))
             .when(got != want, F.format_string("%d vectors for %d texts", got, want)))
    ok = error.isNull()
    return F.struct(
        F.when(ok, texts).alias("texts"),
        F.when(ok, F.transform(doc["data"], lambda d: d["embedding"])).alias("embeddings"),
        F.when(ok, got).alias("n_texts"),
        F.when(ok, doc["usage"]["prompt_tokens"]).alias("prompt_tokens"),
        error.alias("error"))


def _first_content(body: Column) -> tuple[Column, Column, Column]:
    doc = F.from_json(body, CHAT_BODY)
    content = F.get(doc["choices"], 0)["message"]["content"]
    error = F.when(content.isNull(), F.lit("response has no message content"))
    return doc, content, error


def parse_chat(body: Column) -> Column:
    """struct(response, prompt_tokens, completion_tokens, error)."""
    doc, content, error = _first_content(body)
    return F.struct(content.alias("response"),
                    doc["usage"]["prompt_tokens"].alias("prompt_tokens"),
                    doc["usage"]["completion_tokens"].alias("completion_tokens"),
                    error.alias("error"))


def parse_page(model: str, body: Column) -> Column:
    """struct(markdown, model, prompt_tokens, completion_tokens, error)."""
    doc, content, error = _first_content(body)
    return F.struct(content.alias("markdown"), F.lit(model).alias("model"),
                    doc["usage"]["prompt_tokens"].alias("prompt_tokens"),
                    doc["usage"]["completion_tokens"].alias("completion_tokens"),
                    error.alias("error"))
