"""The job description, checked before any Spark action starts."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace

TASKS = ("embeddings", "generation", "ocr")
DEFAULT_EMBED_BATCH = 64


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class JobSpec:
    task: str
    dataset: str                      # table name, path, or (ocr) a glob of page files
    model: str
    output: str
    config: str = "default"
    split: str = "train"
    column: str = "text"
    id_column: str | None = None      # unique row id; the place in the source when absent
    world: int = 1
    batch: int | None = None          # items per row of output
    limit: int | None = None          # cap on input items
    num_examples: int | None = None   # size of the split, when known
    publish: str | None = None        # target of a clean copy once all shards are done
    max_tokens: int = 512
    temperature: float = 0.7
    truncate: int | None = None       # characters kept of a text; whole texts when absent
    settings: dict = field(default_factory=dict)  # model settings, data only

    def __post_init__(self):
        if self.task not in TASKS:
            raise SpecError(f"unknown task {self.task!r}; one of {', '.join(TASKS)}")
        for name, low in (("world", 1), ("max_tokens", 1), ("temperature", 0),
                          ("truncate", 1), ("limit", 0)):
            value = getattr(self, name)
            if value is not None and value < low:
                raise SpecError(f"{name} must be at least {low}, got {value}")
        if self.task == "embeddings":
            batch = DEFAULT_EMBED_BATCH if self.batch is None else self.batch
            if batch < 1:
                raise SpecError(f"batch must be at least 1, got {batch}")
            object.__setattr__(self, "batch", batch)
            return
        if self.batch not in (None, 1):
            raise SpecError(f"{self.task} sends one item per request (batch=1)")
        object.__setattr__(self, "batch", 1)
        if self.task == "ocr":
            if ".pdf" in self.dataset.lower():
                raise SpecError("pdf files must be rendered to page images first")
            if not any(c in self.dataset for c in "*?["):
                raise SpecError("ocr reads a glob of page images, such as /scans/**/*.png")

    @property
    def expected_items(self) -> int | None:
        known = [n for n in (self.limit, self.num_examples) if n]
        return min(known) if known else None

    @property
    def expected_rows(self) -> int | None:
        items = self.expected_items
        return None if items is None else math.ceil(items / self.batch)

    def with_size(self, n: int | None) -> JobSpec:
        return replace(self, num_examples=n)

    def identity(self) -> dict:
        """The fields that fix what a row id and its result stand for; a resume must not
        change them."""
        names = ("task", "dataset", "config", "split", "column", "id_column",
                 "batch", "limit", "truncate", "model", "max_tokens", "temperature", "settings")
        return {n: getattr(self, n) for n in names}

    def to_dict(self) -> dict:
        return asdict(self)
