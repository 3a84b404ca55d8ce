"""Katz backoff language model: counted, discounted, normalised and evaluated over whole texts.

A model of order n knows the counts of all runs of 1 to n training tokens (words, A-Z
lower-cased, and one end per text; a text's start is a context). Counts r up to ``MAX_COUNT`` are
discounted by Good-Turing,

    d(r) = (r*/r - q) / (1 - q),   r* = (r + 1) n(r+1) / n(r),   q = (MAX_COUNT + 1) n(MAX_COUNT+1) / n(1),

with a smaller bound, and at last an absolute discount, where the counts of counts allow
none. With c(h) the count of context h,

    P(w | h) = d(c(hw)) c(hw) / c(h)      if hw was seen
             = alpha(h) P(w | h')         otherwise, h' being h without its first token,

where alpha(h) divides what the discounts leave by the lower-order mass of the unseen, so
that each context sums to 1 exactly. A context whose discounts leave nothing has its count
raised by one. The unigram level leaves its discounts to one unknown word.

How it runs. Texts become chunks: rows that hold about ``CHUNK_TOKENS`` tokens as numbers into the
chunk's own word list. A chunk asks for each distinct n-gram once; the questions, which carry
the chunk's training counts, meet in buckets of n-gram hashes, are summed there, and
the totals go back to the chunks and into the stored model. A seen n-gram is owned by one
of its chunks, which adds its discount and its lower-order mass to its context; these sums
meet in buckets of contexts, and alpha goes back in the same way. So a frequent n-gram or
context counts once for each chunk, whatever its share of the corpus, and nothing is sent to
all tasks but a handful of discounts. N-grams are told apart by 64-bit hashes.

The model lies in the shared folder: ``katz-counts`` (kind=model, by order and bucket) and
``katz-contexts``.

Defined results: a null or empty text is the end token alone; equal rows are each
scored; rows without id are scored; without training texts every probability is that of
the unknown word, 1; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import batch_of, buckets, ddl, groups, pack, pack_sorted, unpack, unpack_sorted
from .tables import release, staged
from .words import mix, slices, words

CHUNK_TOKENS = 1_000_000
BUCKET_KEYS = 1 << 20
MAX_COUNT = 5

_U = np.uint64
END, START = _U(0x7C0F5E2D91A3B846), _U(0x1B56D4A39E0C77F3)
_STEP = _U(0xC2B2AE3D27D4EB4F)


# --- discounts -----------------------------------------------------------------------------

class Discounts:
    """Discount factors of one order, from its counts of counts."""

    def __init__(self, of_counts: np.ndarray, tokens: int, types: int):
        """``of_counts[r]`` n-grams were seen r times, for r up to ``MAX_COUNT + 1``."""
        self.tokens, self.types = tokens, types
        n = of_counts.astype(np.float64)
        self.factor = np.ones(MAX_COUNT + 2)
        for bound in range(MAX_COUNT, 0, -1):
            if (n[1:bound + 2] <= 0).any():
                continue
            r = np.arange(1, bound + 1)
            spare = (bound + 1) * n[bound + 1] / n[1]
            if spare >= 1:
                continue
            d = ((r + 1) * n[2:bound + 2] / n[1:bound + 1] / r - spare) / (1 - spare)
            if ((d > 0) & (d < 1)).all():
                self.factor[1:bound + 1] = d
                return
        total = n[1] + 2 * n[2]
        take = n[1] / total if total and n[2] else 0.5
        r = np.arange(1, MAX_COUNT + 1)
        self.factor[1:MAX_COUNT + 1] = (r - take) / r

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * self.factor[np.minimum(counts, MAX_COUNT + 1)]


class Unigrams:
    def __init__(self, discounts: Discounts, of_counts: np.ndarray):
        self.discounts, n = discounts, discounts.tokens
        r = np.arange(MAX_COUNT + 2)
        lost = float((of_counts * (r - discounts.kept(r)))[1:MAX_COUNT + 1].sum())
        self.total = n if lost > 1e-9 else n + 1
        self.unknown = (lost if lost > 1e-9 else 1) / self.total

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.kept(counts) / self.total, self.unknown)


# --- chunks --------------------------------------------------------------------------------

CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, sizes binary, tokens binary, words binary, n long"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, held) to chunks."""
    part, number = TaskContext.get().partitionId(), 0
    ids, held, sizes, hashes, count = [], [], [], [], 0

    def close():
        used, back, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return pa.RecordBatch.from_arrays([
            pa.array([part << 32 | number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
            pa.array([held], pa.list_(pa.bool_())), pa.array([np.concatenate(sizes).astype(np.int64).tobytes()]),
            pa.array([pack(rank[back])]), pa.array([used[order].tobytes()]), pa.array([len(back)], pa.int64())],
            names=["chunk", "doc_ids", "held", "sizes", "tokens", "words", "n"])

    for batch in batches:
        all_ids, all_held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for texts in slices(batch.column(1)):
            found = words(texts)
            rows = slice(texts.first_row, texts.first_row + len(texts))
            ids += all_ids[rows]
            held += [bool(x) for x in all_held[rows]]
            sizes.append(found.counts + 1)
            hashes.append(np.insert(found.hashes, np.cumsum(found.counts), END))
            count += len(hashes[-1])
            if count >= CHUNK_TOKENS:
                yield close()
                number += 1
                ids, held, sizes, hashes, count = [], [], [], [], 0
    if sizes:
        yield close()


class Chunk:
    """Tokens of a chunk with the keys of their n-grams, order by order."""

    def __init__(self, doc_ids, held, sizes: bytes, tokens: bytes, words_: bytes):
        self.doc_ids, self.sizes = doc_ids, np.frombuffer(sizes, np.int64)
        self.held = np.array(held, dtype=bool)
        self.word = np.frombuffer(words_, np.uint64)[unpack(tokens, np.uint32)]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.training = ~self.held[self.doc]
        self.key = mix(self.word)
        self.order = 1
        self.context = None

    def next_order(self) -> None:
        """From n-grams to those longer by one: a context is the n-gram of the token before."""
        self.order += 1
        context = np.empty_like(self.key)
        context[1:] = self.key[:-1]
        context[self.first] = mix(np.array([START + _U(self.order)]))[0]
        self.context = context
        self.key = mix(context * _STEP + self.word)

    def before(self, counts: np.ndarray, start: int) -> np.ndarray:
        """Each token's context count, given the counts of the n-grams that end at each token."""
        out = np.empty_like(counts)
        out[1:] = counts[:-1]
        out[self.first] = start
        return out


def _ask(order: int, bits: int):
    """Chunks to questions (order, bucket, chunk, keys, counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                chunk = Chunk(*row[1:6])
                rows: list = []
                for n in range(1, order + 1):
                    if n > 1:
                        chunk.next_order()
                    keys, back = np.unique(chunk.key, return_inverse=True)
                    counts = np.bincount(back, chunk.training, minlength=len(keys)).astype(np.uint32)
                    rows += [(n, b, row[0], pack_sorted(keys[s]), pack(counts[s])) for b, s in buckets(keys, bits)]
                yield batch_of(rows, _QUESTION)
    return run


_QUESTION = {"order": pa.int32(), "bucket": pa.int32(), "chunk": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
_COUNTED = {"kind": pa.string(), "order": pa.int32(), "bucket": pa.int32(), "chunk": pa.int64(),
            "keys": pa.binary(), "counts": pa.binary(), "own": pa.binary(), "stats": pa.list_(pa.int64())}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions of a bucket to totals: for each chunk, for the model, and counts of counts."""
    for (order, bucket), rows in groups(batches, 2):
        keys = [unpack_sorted(r[1]) for r in rows]
        counts = np.concatenate([unpack(r[2], np.uint32) for r in rows]).astype(np.int64)
        flat = np.concatenate(keys)
        used, back = np.unique(flat, return_inverse=True)
        total = np.bincount(back, counts, minlength=len(used)).astype(np.int64)
        # The owner of a seen n-gram is the first chunk with it.
        owner = np.full(len(used), -1, dtype=np.int64)
        owner[back[::-1]] = np.arange(len(flat))[::-1]
        own = (owner[back] == np.arange(len(flat))) & (total[back] > 0)
        ends = np.cumsum([len(k) for k in keys])
        out = [("answer", order, bucket, r[0], None, pack(total[back[e - len(k):e]].astype(np.uint64)),
                np.packbits(own[e - len(k):e]).tobytes(), None) for r, k, e in zip(rows, keys, ends)]
        seen = total > 0
        of_counts = np.bincount(total[seen & (total <= MAX_COUNT + 1)], minlength=MAX_COUNT + 2)
        out.append(("model", order, bucket, None, pack_sorted(used[seen]), pack(total[seen].astype(np.uint64)), None, None))
        out.append(("stats", order, bucket, None, None, None, None, [*of_counts.tolist(), int(total.sum()), int(seen.sum())]))
        yield batch_of(out, _COUNTED)


class Model:
    """What every task needs of the model: discounts of each order, and the tokens' number."""

    def __init__(self, stats: dict[int, np.ndarray], order: int):
        empty = np.zeros(MAX_COUNT + 4, dtype=np.int64)
        rows = [stats.get(k, empty) for k in range(1, order + 1)]
        self.discounts = [Discounts(r[:MAX_COUNT + 2], int(r[-2]), int(r[-1])) for r in rows]
        self.unigrams = Unigrams(self.discounts[0], rows[0][:MAX_COUNT + 2])
        self.order = order

    def evaluate(self, chunk: Chunk, totals: list[np.ndarray], alphas: list[np.ndarray], texts: int):
        """Walk up the orders: yields (order, keys, back, counts, context counts, probability of the order below)."""
        p = self.unigrams.probability(totals[0][np.unique(chunk.key, return_inverse=True)[1]])
        counts = totals[0][np.unique(chunk.key, return_inverse=True)[1]]
        for k in range(2, self.order + 1):
            chunk.next_order()
            keys, at, back = np.unique(chunk.key, return_index=True, return_inverse=True)
            above = chunk.before(counts, texts)
            counts = totals[k - 1][back]
            yield k, at, back, counts, above, p
            if len(alphas) < k - 1:
                return
            # Contexts never seen have nothing to say: alpha 1.
            known = above > 0
            contexts, where = np.unique(chunk.context[known], return_inverse=True)
            alpha = np.ones(len(p))
            alpha[known] = alphas[k - 2][where]
            raised = alpha < 0
            seen = counts > 0
            p = np.where(seen, self.discounts[k - 1].kept(counts) / np.maximum(above + raised, 1), np.abs(alpha) * p)
        yield self.order + 1, None, None, counts, None, p


# Rows of a chunk meet under one schema: the chunk, its answers, then its contexts, in key order.
_MEETING = ("chunk", "kind", "order", "bucket", "doc_ids", "held", "sizes", "tokens", "words", "counts", "own")


def _meeting(chunks: DataFrame, answers: DataFrame, contexts: list[DataFrame]) -> DataFrame:
    none = {"doc_ids": "array<long>", "held": "array<boolean>", "sizes": "binary", "tokens": "binary", "words": "binary",
            "counts": "binary", "own": "binary"}

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        have = set(df.columns)
        return df.select(
            "chunk", F.lit(kind).alias("kind"),
            *(F.col(c) if c in have else F.lit(0).alias(c) for c in ("order", "bucket")),
            *(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in none.items()))

    rows = shaped(chunks, 0).unionByName(shaped(answers, 1))
    for c in contexts:
        rows = rows.unionByName(shaped(c, 2))
    return rows.repartition("chunk").sortWithinPartitions("chunk", "kind", "order", "bucket")


def _chunks(batches: Iterator[pa.RecordBatch], order: int):
    """(chunk number, chunk, totals by order, owned by order, alphas by order)."""
    for (number,), rows in groups(batches, 1):
        body, totals, owned, alphas = None, [[] for _ in range(order)], [[] for _ in range(order)], {}
        for kind, n, _, doc_ids, held, sizes, tokens, words_, counts, own in rows:
            if kind == 0:
                body = Chunk(doc_ids, held, sizes, tokens, words_)
            elif kind == 1:
                totals[n - 1].append(unpack(counts, np.uint64).astype(np.int64))
                owned[n - 1].append(np.unpackbits(np.frombuffer(own, np.uint8), count=len(totals[n - 1][-1])).astype(bool))
            else:
                alphas.setdefault(n, []).append(np.frombuffer(counts, np.float64))
        yield (number, body, [np.concatenate(x) for x in totals], [np.concatenate(x) for x in owned],
               [np.concatenate(alphas[k]) if k in alphas else np.empty(0) for k in range(2, max(alphas, default=1) + 1)])


def _texts_in_training(chunk_totals: np.ndarray, chunk: Chunk) -> int:
    """The end token's count, which every chunk knows."""
    keys = np.unique(mix(chunk.word))
    return int(chunk_totals[np.searchsorted(keys, mix(np.array([END]))[0])])


_CONTEXT_QUESTION = {"bucket": pa.int32(), "chunk": pa.int64(), "keys": pa.binary(), "above": pa.binary(),
                     "lost": pa.binary(), "lower": pa.binary()}
_CONTEXT = {"kind": pa.string(), "order": pa.int32(), "bucket": pa.int32(), "chunk": pa.int64(), "keys": pa.binary(),
            "above": pa.binary(), "counts": pa.binary()}


def _ask_contexts(model: Model, order: int, bits: int):
    """For each context of a chunk: what its owned n-grams lose, and their lower-order mass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, totals, owned, alphas in _chunks(batches, model.order):
            texts = _texts_in_training(totals[0], chunk)
            for k, at, back, counts, above, p in model.evaluate(chunk, totals, alphas, texts):
                if k == order:
                    break
            known = np.flatnonzero(above > 0)
            contexts, where, back = np.unique(chunk.context[known], return_index=True, return_inverse=True)
            place = np.full(len(chunk.context), -1, dtype=np.int64)
            place[known] = back
            mine = at[owned[order - 1]]
            mine = mine[place[mine] >= 0]
            n = counts[mine].astype(np.float64)
            lost = np.bincount(place[mine], n - model.discounts[order - 1].kept(counts[mine]), len(contexts))
            lower = np.bincount(place[mine], p[mine], len(contexts))
            count = above[known][where].astype(np.uint64)
            rows = [(b, number, pack_sorted(contexts[s]), pack(count[s]), pack(lost[s]), pack(lower[s]))
                    for b, s in buckets(contexts, bits)]
            yield batch_of(rows, _CONTEXT_QUESTION)
    return run


def _backoff(order: int):
    """Questions of a bucket of contexts to alpha, negative where the context's count is raised by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in groups(batches, 1):
            keys = [unpack_sorted(r[1]) for r in rows]
            used, back = np.unique(np.concatenate(keys), return_inverse=True)
            lost, lower = (np.bincount(back, np.concatenate([unpack(r[k], np.float64) for r in rows]), len(used))
                           for k in (3, 4))
            above = np.zeros(len(used), dtype=np.uint64)
            above[back] = np.concatenate([unpack(r[2], np.uint64) for r in rows])
            raised = lost <= 1e-9
            left = np.where(raised, (lost + 1) / (above + 1), lost / np.maximum(above, 1))
            alpha = np.where(raised, -1.0, 1.0) * left / np.maximum(1 - lower, 1e-300)
            ends = np.cumsum([len(k) for k in keys])
            out = [("answer", order, bucket, r[0], None, None, alpha[back[e - len(k):e]].tobytes())
                   for r, k, e in zip(rows, keys, ends)]
            out.append(("model", order, bucket, None, pack_sorted(used), pack(above), alpha.tobytes()))
            yield batch_of(out, _CONTEXT)
    return run


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = model.discounts[0]
        for _, chunk, totals, _, alphas in _chunks(batches, model.order):
            texts = _texts_in_training(totals[0], chunk)
            count = totals[0][np.unique(chunk.key, return_inverse=True)[1]]
            p = model.unigrams.probability(count)
            for *_, p in model.evaluate(chunk, totals, alphas, texts):
                pass
            rows = len(chunk.sizes)
            plain = np.log10((count + 0.5) / (base.tokens + 0.5 * (base.types + 1)))
            yield pa.RecordBatch.from_arrays([
                pa.array(chunk.doc_ids, pa.int64()), pa.array(chunk.held), pa.array(chunk.sizes),
                pa.array(np.bincount(chunk.doc, count > 0, rows).astype(np.int64)),
                pa.array(np.full(rows, base.tokens, dtype=np.int64)),
                pa.array(np.bincount(chunk.doc, plain, rows)), pa.array(np.bincount(chunk.doc, np.log10(p), rows))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def katz_scores(docs: DataFrame, held_out: Column, order: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows where ``held_out`` is false, and score all rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held"))
    chunks = staged(rows.mapInArrow(_encode, CHUNKS), "katz-chunks")
    size = chunks.agg(F.sum("n")).first()[0] or 0
    bits = int(size // BUCKET_KEYS).bit_length()
    counted = staged(
        chunks.mapInArrow(_ask(order, bits), ddl(_QUESTION)).repartition("order", "bucket")
        .sortWithinPartitions("order", "bucket", "chunk").mapInArrow(_count, ddl(_COUNTED)),
        "katz-counts", "kind", "order")
    release(spark)
    width = MAX_COUNT + 4
    sums = counted.filter("kind = 'stats'").groupBy("order").agg(
        *(F.sum(F.element_at("stats", k + 1)).alias(f"s{k}") for k in range(width))).collect()
    model = Model({r["order"]: np.array([r[f"s{k}"] for k in range(width)]) for r in sums}, order)
    answers = counted.filter("kind = 'answer'").select("chunk", "order", "bucket", "counts", "own")
    contexts: list[DataFrame] = []
    for k in range(2, order + 1):
        asked = _meeting(chunks, answers, contexts).mapInArrow(_ask_contexts(model, k, bits), ddl(_CONTEXT_QUESTION))
        found = staged(asked.repartition("bucket").sortWithinPartitions("bucket", "chunk")
                       .mapInArrow(_backoff(k), ddl(_CONTEXT)), "katz-contexts", "kind", "order")
        release(spark)
        contexts.append(found.filter("kind = 'answer'").select("chunk", "order", "bucket", "counts"))
    return _meeting(chunks, answers, contexts).mapInArrow(_score(model), SCORES)
