"""Quality rules: counts of each text, and its divergence from its language.

A language's reference is the distribution of character classes, and of its
``COMMON_WORDS`` most frequent words plus one cell for all others, over all its documents.
A document is compared with the reference by the Jensen-Shannon distance (base 2, from 0
to 1). A short text strays by chance, so each comparison has a least length, and its limit
is widened by the distance that sampling noise alone is expected to give.

Base rules: too few words, or too many words in repeated windows of five.

Defined results: a null or empty text has counts of 0 and fails for want of words; a null
language is a language of its own; every language has its own reference. Those with at least
``1 / MAX_LANGUAGES`` of all words or of all documents are sent to the tasks, which are at
most ``2 * MAX_LANGUAGES`` whatever the data; those of the others are joined to their documents by language. A language
that a reference given by the caller lacks gets null distances and the base rules only;
equal counts rank words by their hash; equal rows get equal results; an empty table gives an empty result. Extra columns
are kept, whatever their names; the operator's own are those of ``ADDED``, which replace input columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import free_name, staged
from .words import Texts, Words, keep_only, mix, slices, span_hashes, tidied, window_hashes, words, _LOWER

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
COMMON_WORDS = 100
MAX_LANGUAGES = 1000
#: Least lengths, and the distances beyond which a text is rejected.
CLASS_MIN_CHARS, CLASS_LIMIT = 200, 0.25
COMMON_MIN_WORDS, COMMON_LIMIT = 50, 0.20
#: Bytes of texts that are measured at once; the arrays of a slice take some 100 times as much.
MEASURED_BYTES = 1 << 18
#: Distinct words that a task holds before it hands them on.
HELD_WORDS = 150_000

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
CLASSES = ("lower", "upper", "digit", "space", "point", "sign", "control", "two", "three", "four")
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[33:127] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[128:192] = -1  # continuation bytes belong to the code point before
_CLASS[192:224], _CLASS[224:240], _CLASS[240:256] = 7, 8, 9

COUNTS = ("QR_words", "QR_word_chars", "QR_symbols", "QR_dup_lines", "QR_repeat_words")
DISTANCES = ("QR_class_distance", "QR_common_distance")
ADDED = [*(T.StructField(n, T.LongType()) for n in COUNTS),
         *(T.StructField(n, T.DoubleType()) for n in DISTANCES),
         T.StructField("QR_base_failed", T.BooleanType()), T.StructField("QR_kept", T.BooleanType())]


def _per_text(texts: Texts, marked: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    sums = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
    return sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]


def _repeats(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of (owner, value, position), and which entries equal the one before."""
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    v, o = values[order], owner[order]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    return order, same


def repeat_words(found: Words, width: int = 5) -> np.ndarray:
    """Words of each text inside a window of ``width`` words that the text has twice or more."""
    text = found.text
    whole = window_hashes(found.hashes, width)
    if not len(whole):
        return np.zeros(len(found.counts), dtype=np.int64)
    inside = np.flatnonzero(text[:len(whole)] == text[width - 1:])
    order, same = _repeats(whole[inside], text[inside])
    twice = same.copy()
    twice[:-1] |= same[1:]
    begins = inside[order[twice]]
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + width, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return np.bincount(text[covered], minlength=len(found.counts))


def duplicate_lines(texts: Texts, found: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    breaks = np.flatnonzero(texts.data == 10)
    starts = np.concatenate([texts.offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(texts)), np.searchsorted(texts.offsets, breaks, "right") - 1])
    place = np.lexsort((owner, starts))  # an empty last line may share its start with the next text
    starts, owner = starts[place], owner[place]
    ends = np.append(starts[1:], len(texts.data) + 1) - 1
    last = np.append(owner[1:] != owner[:-1], True)
    ends[last] = texts.offsets[1:][owner[last]]
    keep = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends, owner = starts[keep], ends[keep], owner[keep]
    _, same = order_same = _repeats(span_hashes(texts.data, starts, ends), owner)
    order = order_same[0]
    return np.bincount(owner[order[same]], minlength=len(texts))


def class_counts(texts: Texts) -> np.ndarray:
    """Code points of each text by character class."""
    kind = _CLASS[texts.data]
    owner = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    lead = kind >= 0
    flat = np.bincount(owner[lead] * len(CLASSES) + kind[lead], minlength=len(texts) * len(CLASSES))
    return flat.reshape(len(texts), len(CLASSES))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` from the distribution ``q``; 0 for no counts."""
    total = p.sum(1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2

    def entropy_to(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((entropy_to(p) + entropy_to(q)) / 2, 0, 1)), 0.0)


def noise(q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The distance expected of ``n`` draws from ``q`` itself.

    Cells that n draws hit once or more give about 1 / (8 n ln 2) each; of the others the
    text misses the whole share, which counts half.
    """
    n = np.maximum(n, 1)[:, None]
    return np.sqrt(np.minimum(1 / (8 * n * np.log(2)), q / 2).sum(1))


def _language(value) -> str:
    return "t" if value is None else f"s{value}"


class _Counter:
    """Counts of word hashes by language, merged with numpy and handed on when many."""

    def __init__(self):
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, name: str, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.held.setdefault(name, []).append((hashes, counts))
        self.size += len(hashes)

    def merge(self) -> None:
        self.size = 0
        for name, parts in self.held.items():
            hashes, back = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)
            self.held[name] = [(hashes, counts)]
            self.size += len(hashes)

    def hand_on(self, classes: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.merge()
        for name, ((hashes, counts),) in self.held.items():
            yield _rows(name, hashes, None, counts)
        for name, counts in classes.items():
            yield _rows(name, None, np.arange(len(counts)), counts)
        self.held.clear()
        classes.clear()
        self.size = 0


def _rows(name: str, hashes, kinds, counts) -> pa.RecordBatch:
    n = len(counts)
    return pa.RecordBatch.from_arrays([
        pa.repeat(pa.scalar(name, pa.string()), n),
        pa.nulls(n, pa.int64()) if hashes is None else pa.array(hashes.view(np.int64)),
        pa.nulls(n, pa.int32()) if kinds is None else pa.array(kinds.astype(np.int32)),
        pa.array(counts.astype(np.int64))], names=["lang", "word", "class", "n"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, word hash or null, class or null, count) of the rows seen.

    The class after the last one counts documents.
    """
    keep_only()
    counter, classes = _Counter(), {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for texts in slices(batch.column(0), MEASURED_BYTES):
            found = words(texts)
            number: dict[str, int] = {}
            of_text = np.array([number.setdefault(_language(x), len(number)) for x in
                                langs[texts.first_row:texts.first_row + len(texts)]])
            by_class = class_counts(texts)
            word_lang = of_text[found.text]
            for name, k in number.items():
                mine = of_text == k
                classes[name] = classes.get(name, 0) + np.append(by_class[mine].sum(0), mine.sum())
                counter.add(name, *np.unique(found.hashes[word_lang == k], return_counts=True))
            if counter.size > 2 * HELD_WORDS:
                counter.merge()
            if counter.size > HELD_WORDS or len(classes) > HELD_WORDS:
                yield from counter.hand_on(classes)
    yield from counter.hand_on(classes)


class Reference:
    """Distributions of the languages; number 0 stands for a language without any."""

    def __init__(self, common: dict, classes: dict):
        names = [None, *sorted(common)]
        self.number = {name: k for k, name in enumerate(names)}
        self.common = np.zeros((len(names), COMMON_WORDS + 1))
        self.classes = np.zeros((len(names), len(CLASSES)))
        keys, cells = [], []
        for k, name in enumerate(names):
            ranked, total = common.get(name, ([], 0))
            for cell, (word, n) in enumerate(ranked):
                self.common[k, cell] = n / total
                keys.append(self._key(k, np.array([word], dtype=np.int64).view(np.uint64))[0])
                cells.append(cell)
            self.common[k, COMMON_WORDS] = max(0.0, 1 - self.common[k, :COMMON_WORDS].sum())
            share = classes.get(name)
            if share is not None and share.sum():
                self.classes[k] = share / share.sum()
        order = np.argsort(np.array(keys, dtype=np.uint64))
        self.keys = np.array(keys, dtype=np.uint64)[order]
        self.cells = np.array(cells, dtype=np.int64)[order]

    @staticmethod
    def _key(number, hashes):
        return mix(hashes + np.asarray(number).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def numbers(self, langs: list) -> np.ndarray:
        return np.array([self.number.get(_language(x), 0) for x in langs], dtype=np.int64)

    def common_counts(self, found: Words, hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
        text = found.text
        cell = np.full(len(text), COMMON_WORDS, dtype=np.int64)
        if len(self.keys):
            key = self._key(number[text], hashes)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            cell[hit] = self.cells[at[hit]]
        width = COMMON_WORDS + 1
        return np.bincount(text * width + cell, minlength=len(number) * width).reshape(-1, width)


def _name(lang: Column) -> Column:
    """``_language`` of a column."""
    return F.when(lang.isNull(), "t").otherwise(F.concat(F.lit("s"), lang))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[Reference, DataFrame | None]:
    """References of the large languages, and a table of those of the others, if there are any.

    Counts over all documents; what reaches the driver is bounded by ``2 * MAX_LANGUAGES`` languages.
    """
    gathered = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(
        tidied(_gather), "lang string, word long, class int, n long")
    counts = gathered.groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    counts = staged(counts, "quality-counts")
    totals = counts.groupBy("lang").agg(
        F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)).alias("total"),
        F.sum(F.when(F.col("class") == len(CLASSES), F.col("n"))).alias("docs"))
    # A share of a total bounds how many languages can have it.
    everywhere = totals.agg(F.sum("total"), F.sum("docs")).first()
    share = [F.col(c) * MAX_LANGUAGES >= max(n or 0, 1) for c, n in zip(("total", "docs"), everywhere)]
    kept = {r["lang"]: r["total"] for r in totals.filter(share[0] | share[1]).collect()}
    large = F.col("lang").isin(list(kept)) if kept else F.lit(False)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = (counts.filter("word is not null").withColumn("place", F.row_number().over(order))
           .filter(F.col("place") <= COMMON_WORDS))
    common: dict = {name: ([], total) for name, total in kept.items()}
    classes: dict = {name: np.zeros(len(CLASSES)) for name in kept}
    for r in top.filter(large).orderBy("lang", "place").collect():
        common[r["lang"]][0].append((r["word"], r["n"]))
    of_class = counts.filter(F.col("class") < len(CLASSES))
    for r in of_class.filter(large).collect():
        classes[r["lang"]][r["class"]] += r["n"]
    reference = Reference(common, classes)
    small = of_class.filter(~large)
    if small.isEmpty():  # every language has counts by class, be they 0
        return reference, None
    ranked = top.filter(~large).groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("QR_ranked"))
    table = (small.groupBy("lang").agg(F.collect_list(F.struct("class", "n")).alias("QR_classes"))
             .join(totals.select("lang", F.col("total").alias("QR_total")), "lang").join(ranked, "lang", "left"))
    return reference, staged(table.withColumnRenamed("lang", "QR_name"), "quality-small-languages")


def joined_reference(langs: list, rows: pa.RecordBatch) -> Reference:
    """Reference of the languages of some documents, from the last columns of ``rows``: counts by class, total, words."""
    first: dict[str, int] = {}
    for k, x in enumerate(langs):
        first.setdefault(_language(x), k)
    common, classes = {}, {}
    for name, k in first.items():
        by_class, total, ranked = (c[k].as_py() for c in rows.columns[-3:])
        common[name] = [(x["word"], x["n"]) for x in ranked or ()], total
        classes[name] = np.zeros(len(CLASSES))
        for x in by_class:
            classes[name][x["class"]] = x["n"]
    return Reference(common, classes)


def measure(texts: Texts, langs: list, reference: Reference) -> list[np.ndarray]:
    found = words(texts, lower=False)
    n_words = found.counts.astype(np.int64)
    lead = (texts.data & 0xC0) != 0x80
    inside = np.zeros(len(texts.data) + 1, dtype=np.int64)
    inside[found.starts] += 1
    inside[found.ends] -= 1
    word_chars = _per_text(texts, lead & (np.cumsum(inside)[:-1] > 0))
    repeated = repeat_words(found)
    base_failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
    number = reference.numbers(langs)
    by_class = class_counts(texts)
    chars = by_class.sum(1)
    class_distance = js_distance(by_class, reference.classes[number])
    lowered = span_hashes(_LOWER[texts.data], found.starts, found.ends)
    common = reference.common_counts(found, lowered, number)
    common_distance = js_distance(common, reference.common[number])
    class_distance[number == 0] = common_distance[number == 0] = np.nan  # null, and no verdict
    far = (chars >= CLASS_MIN_CHARS) & (
        class_distance > CLASS_LIMIT + noise(reference.classes[number], chars))
    far |= (n_words >= COMMON_MIN_WORDS) & (
        common_distance > COMMON_LIMIT + noise(reference.common[number], n_words))
    return [n_words, word_chars, _per_text(texts, _SYMBOLS[texts.data]), duplicate_lines(texts, found),
            repeated, class_distance, common_distance, base_failed, ~(base_failed | far)]


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None,
            reference: Reference | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with the ``QR_*`` columns."""
    given, small = (reference, None) if reference else references(docs, text, lang)
    own = {f.name.lower() for f in ADDED}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own]
    fields = [docs.schema[name] for name in keep]
    # The text travels once: as a column that is kept, or else beside these.
    first = 1 if text in keep else 2
    text_at = first + keep.index(text) if text in keep else 1

    def run(batches: Iterator[pa.RecordBatch], joined: bool = False) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            parts = []
            for t in slices(batch.column(text_at), MEASURED_BYTES):
                own = langs[t.first_row:t.first_row + len(t)]
                parts.append(measure(t, own, joined_reference(own, batch.slice(t.first_row, len(t))) if joined else given))
            if parts:
                added = [pa.array(np.concatenate(x), from_pandas=True) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[first:first + len(keep)], *added], names=[*keep, *(f.name for f in ADDED)])

    lang_at, text_alone, name_at = (free_name(docs, c) for c in ("QR_lang", "QR_text", "QR_name"))
    beside = [] if text in keep else [F.col(text).alias(text_alone)]
    source = docs.select(F.col(lang).cast("string").alias(lang_at), *beside, *keep)
    schema = T.StructType([*fields, *ADDED])
    if small is None:
        return source.mapInArrow(tidied(run), schema)
    name = _name(F.col(lang_at))
    large = name.isin([x for x in given.number if x is not None])
    small = small.select(F.col("QR_name").alias(name_at), *(
        F.col(c).alias(free_name(docs, c)) for c in ("QR_classes", "QR_total", "QR_ranked")))
    of_small = source.filter(~large).withColumn(name_at, name).join(small, name_at).select(
        *source.columns, *small.columns[1:])
    return source.filter(large).mapInArrow(tidied(run), schema).union(
        of_small.mapInArrow(tidied(lambda batches: run(batches, True)), schema))
