"""The model protocol, a registry, and deterministic stand-ins for tests.

A model has ``predict(requests) -> bodies``: a list of request dicts in, one response
dict each out. ``group_size`` says how many requests it wants at once. Settings are
data; the factory runs once per Python task. The models here are test doubles, real
ones are registered by the user.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import partial

DIMENSIONS = 16


class HashEmbedder:
    """Counts of blank-separated tokens by the first hex digit of their md5."""

    group_size = 8
    known_tokens = 65_536
    known_length = 64       # longer tokens hardly come again

    def __init__(self):
        self._buckets: dict[str, int] = {}

    def _bucket(self, token: str) -> int:
        bucket = self._buckets.get(token)
        if bucket is None:
            bucket = int(hashlib.md5(token.encode()).hexdigest()[0], 16)
            if len(self._buckets) < self.known_tokens and len(token) <= self.known_length:
                self._buckets[token] = bucket
        return bucket

    def predict(self, requests):
        return [self._one(r["input"]) for r in requests]

    def _one(self, texts):
        data, total = [], 0
        for text in texts:
            counts = [0.0] * DIMENSIONS
            for token in text.split(" "):
                if token:
                    counts[self._bucket(token)] += 1.0
                    total += 1
            data.append({"embedding": counts})
        return {"data": data, "usage": {"prompt_tokens": total}}


def _chat(content: str, prompt_tokens: int) -> dict:
    return {"choices": [{"message": {"content": content}}],
            "usage": {"prompt_tokens": prompt_tokens,
                      "completion_tokens": len(content)}}


class EchoGenerator:
    """Answers ``<prefix><prompt>``; token counts are character counts."""

    def __init__(self, prefix: str = "echo: "):
        self.prefix = prefix

    def predict(self, requests):
        prompts = [r["messages"][0]["content"] or "" for r in requests]
        return [_chat(self.prefix + p, len(p)) for p in prompts]


class TagStripper:
    """Reads a page of markup as its text; token counts are character counts."""

    def predict(self, requests):
        bodies = []
        for request in requests:
            url = request["messages"][0]["content"][-1]["image_url"]["url"]
            page = base64.b64decode(url.split(",", 1)[1]).decode("utf-8")
            bodies.append(_chat(re.sub(r"<[^>]*>", "", page), len(page)))
        return bodies


class Faulty:
    """Wraps a model: raises for texts matching ``raise_on``, drops a vector for ``short_on``."""

    def __init__(self, inner: str = "hash-embedder", raise_on: str | None = None,
                 short_on: str | None = None):
        self.inner = build(inner)()
        self.raise_on, self.short_on = raise_on, short_on
        self.group_size = getattr(self.inner, "group_size", 1)

    def predict(self, requests):
        texts = [str(r.get("input") or r.get("messages")) for r in requests]
        if self.raise_on and any(re.search(self.raise_on, t) for t in texts):
            raise RuntimeError("model refused the request")
        bodies = self.inner.predict(requests)
        for text, body in zip(texts, bodies):
            if self.short_on and re.search(self.short_on, text):
                body["data"].pop()
        return bodies


REGISTRY: dict[str, Callable] = {
    "hash-embedder": HashEmbedder,
    "echo": EchoGenerator,
    "tag-stripper": TagStripper,
    "faulty": Faulty,
}


def register(name: str, factory: Callable) -> None:
    REGISTRY[name] = factory


def build(name: str, settings: dict | None = None) -> Callable:
    """A zero-argument factory that is sent to the executors."""
    if name not in REGISTRY:
        raise KeyError(f"no model {name!r}; register(name, factory) adds one")
    return partial(REGISTRY[name], **(settings or {}))
