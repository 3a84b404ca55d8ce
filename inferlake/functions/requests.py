"""Model requests as JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def embedding_request(model: str, texts: Column) -> Column:
    return F.to_json(F.struct(F.lit(model).alias("model"), texts.alias("input")))


def _sampling(**values) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in values.items()]


def chat_request(model: str, prompt: Column, max_tokens: int = 512,
                 temperature: float = 0.7) -> Column:
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"),
                    *_sampling(max_tokens=max_tokens, temperature=float(temperature)))
    # a null prompt stays visible as null instead of vanishing from the message
    return F.to_json(body, {"ignoreNullFields": "false"})


def page_request(model: str, content: Column, prompt: str | None = None,
                 max_tokens: int = 4096, temperature: float = 0.2, top_p: float = 0.9,
                 mime: str = "image/png") -> Column:
    """One page as a data URL, after an optional instruction."""
    encoded = F.translate(F.base64(content), "\r\n", "")   # Spark may break the lines
    url = F.concat(F.lit(f"data:{mime};base64,"), encoded)
    no_text = F.lit(None).cast("string").alias("text")
    no_url = F.lit(None).cast("struct<url:string>").alias("image_url")
    said = F.struct(F.lit("text").alias("type"), F.lit(prompt).alias("text"), no_url)
    page = F.struct(F.lit("image_url").alias("type"), no_text, F.struct(url.alias("url")).alias("image_url"))
    items = [said, page] if prompt else [page]
    message = F.struct(F.lit("user").alias("role"), F.array(*items).alias("content"))
    return F.to_json(F.struct(
        F.lit(model).alias("model"), F.array(message).alias("messages"),
        *_sampling(max_tokens=max_tokens, temperature=float(temperature),
                   top_p=float(top_p))))
