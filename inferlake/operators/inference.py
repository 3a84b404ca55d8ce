"""A model applied to work units inside Arrow-batched Python tasks.

Only the request columns travel to Python; everything else stays in the JVM. The
model is built once per task. A unit that fails becomes a row with ``error`` set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBEDDING_RESULT = ("embeddings array<array<float>>, n_texts int, "
                    "prompt_tokens bigint, error string")
PIECE_BYTES = 4 << 20
CHAT_RESULT = ("response string, prompt_tokens bigint, "
               "completion_tokens bigint, error string")


def _answers(model, requests: Iterable[dict]) -> Iterator[tuple[dict | None, str | None]]:
    """One (body, error) per request. A failing group is repeated one by one, so one
    bad request does not spoil its neighbours. Requests are built a group at a time."""
    requests, size = iter(requests), max(1, getattr(model, "group_size", 1))
    while group := list(islice(requests, size)):
        try:
            bodies = model.predict(group)
            if len(bodies) != len(group):
                raise ValueError(f"expected {len(group)} bodies, got {len(bodies)}")
            yield from ((body, None) for body in bodies)
        except Exception as exc:
            if len(group) == 1:
                yield None, _message(exc)
                continue
            for request in group:
                try:
                    (body,) = model.predict([request])
                    yield body, None
                except Exception as single:
                    yield None, _message(single)


def _pieces(batches: Iterable[pa.Array], group: int) -> Iterator[pa.Array]:
    """Slices of a few megabytes, of whole groups of requests. Spark fills an Arrow batch with up to 64 MB; as Python objects
    its rows would take many times that. Results are handed on a slice at a time, and Arrow gives memory back after a batch."""
    for batch in batches:
        rows = PIECE_BYTES * len(batch) // max(1, batch.nbytes) // group * group or group
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)
        del batch
        pa.default_memory_pool().release_unused()


def _message(exc: Exception) -> str:
    return f"{type(exc).__name__}: {exc}"


def _float_lists(rows: list[list | None]) -> pa.Array:
    """array<array<float>> from vectors, through one flat buffer."""
    outer, inner, flat = [0], [0], []
    for vectors in rows:
        for vector in vectors or ():
            flat.append(np.asarray(vector, dtype=np.float32))
            inner.append(inner[-1] + len(flat[-1]))
        outer.append(len(flat))
    values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.float32), pa.float32())
    vectors = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), values)
    missing = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), vectors, mask=missing)


def embed_column(texts: Column, name: str, factory: Callable) -> Column:
    """struct(embeddings, n_texts, prompt_tokens, error) for a column of text arrays."""

    @F.arrow_udf(EMBEDDING_RESULT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for batch in _pieces(batches, max(1, getattr(model, "group_size", 1))):
            inputs = batch.to_pylist()
            del batch
            vectors, counts, tokens, errors = [], [], [], []
            answers = _answers(model, ({"model": name, "input": t} for t in inputs))
            for given, (body, error) in zip(inputs, answers):
                try:
                    if error is None:
                        found = [d["embedding"] for d in body["data"]]
                        if len(found) != len(given):
                            error = f"{len(found)} vectors for {len(given)} texts"
                except Exception as exc:
                    error = _message(exc)
                good = error is None
                vectors.append(found if good else None)
                counts.append(len(found) if good else None)
                tokens.append((body.get("usage") or {}).get("prompt_tokens") if good else None)
                errors.append(error)
            yield pa.StructArray.from_arrays(
                [_float_lists(vectors), pa.array(counts, pa.int32()),
                 pa.array(tokens, pa.int64()), pa.array(errors, pa.string())],
                names=["embeddings", "n_texts", "prompt_tokens", "error"])

    return score.asNondeterministic()(texts)


def chat_column(content: Column, factory: Callable, to_request: Callable) -> Column:
    """struct(response, prompt_tokens, completion_tokens, error); ``to_request`` turns
    one value of ``content`` into a request."""

    @F.arrow_udf(CHAT_RESULT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for batch in _pieces(batches, max(1, getattr(model, "group_size", 1))):
            contents, rows = batch.to_pylist(), []
            del batch
            for body, error in _answers(model, map(to_request, contents)):
                row = {"response": None, "prompt_tokens": None, "completion_tokens": None}
                if error is None:
                    try:
                        usage = body.get("usage") or {}
                        row = {"response": body["choices"][0]["message"]["content"],
                               "prompt_tokens": usage.get("prompt_tokens"),
                               "completion_tokens": usage.get("completion_tokens")}
                    except Exception as exc:
                        error = _message(exc)
                rows.append({**row, "error": error})
            yield pa.array(rows, pa.struct([
                ("response", pa.string()), ("prompt_tokens", pa.int64()),
                ("completion_tokens", pa.int64()), ("error", pa.string())]))

    return score.asNondeterministic()(content)


def _spread(df: DataFrame, result: Column) -> DataFrame:
    kept = [c for c in df.columns]
    return df.withColumn("_result", result).select(*kept, "_result.*")


def embed_units(units: DataFrame, name: str, factory: Callable) -> DataFrame:
    """Batches plus their vectors; one vector per text or an error."""
    return _spread(units, embed_column(F.col("texts"), name, factory))


def generate_rows(rows: DataFrame, column: str, name: str, factory: Callable,
                  max_tokens: int = 512, temperature: float = 0.7) -> DataFrame:
    def to_request(prompt):
        return {"model": name, "messages": [{"role": "user", "content": prompt}],
                "max_tokens": max_tokens, "temperature": temperature}

    return _spread(rows, chat_column(F.col(column), factory, to_request))


def read_pages(pages: DataFrame, content: str, name: str, factory: Callable,
               prompt: str | None = None, max_tokens: int = 4096,
               temperature: float = 0.2, top_p: float = 0.9) -> DataFrame:
    """Pages to markdown; the bytes do not come back from Python."""
    import base64

    def to_request(data):
        page = f"data:image/png;base64,{base64.b64encode(data).decode()}"
        items = [{"type": "text", "text": prompt}] if prompt else []
        items.append({"type": "image_url", "image_url": {"url": page}})
        return {"model": name, "messages": [{"role": "user", "content": items}],
                "max_tokens": max_tokens, "temperature": temperature, "top_p": top_p}

    scored = _spread(pages, chat_column(F.col(content), factory, to_request))
    return (scored.withColumnRenamed("response", "markdown")
            .withColumn("model", F.lit(name)).drop(content))
