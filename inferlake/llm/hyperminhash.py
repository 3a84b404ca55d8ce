"""Near-duplicate groups by HyperMinHash registers, banding and exact verification.

A text's set holds its distinct runs of five words (all its words as one run, where it has
fewer; lower-cased A-Z). Each of ``BANDS * ROWS`` buckets permutes the hashes in its own
way and keeps only the leading-zero count (6 bits) and ten mantissa bits of its smallest
value, so that short sets fill all buckets, too. Four registers make a band. Texts that
share a band are candidates; clusters of candidates meet in one task (large ones in pairs of
blocks), where a Jaccard estimate corrected for chance register collisions goes before the
intersection of the full sets.

Equal sets are folded into one node first. Registers go through shuffles for nodes
alone, sets only for nodes with a candidate. There is no cap on buckets or partners. A link
at the threshold shares no band with a probability of ``(1 - t**ROWS)**BANDS``: 5e-11 at
0.85, 5e-8 at 0.8.

Defined results: null, empty and blank texts have an empty set and are linked with nothing;
equal rows are each returned, with equal results; of equal ids nothing is assumed but that
they name the text; rows without id take part and get their group's smallest id; an
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmap import among, bitmap, passes, without
from .components import components
from .tables import release, staged
from .words import SHINGLE, keep_only, mix, shingles, slices, tidied, words

ROWS, BANDS = 4, 32
MANTISSA = 10
#: Shingles of a block; a cluster beyond it is verified in pairs of blocks.
BLOCK_SHINGLES = 1_000_000
#: Standard errors below the threshold at which an estimate rules a pair out.
DEVIATIONS = 6.5

_MULTIPLIERS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_OFFSETS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def register(smallest: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the first one, of 64-bit minima."""
    part, exponent = np.frexp(smallest.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63)
    rest = np.clip((2 * part - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | rest.astype(np.uint16)


def registers(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One row of registers for each set; set ``i`` begins at ``values[begins[i]]`` and isn't empty."""
    out = np.empty((len(begins), ROWS * BANDS), dtype=np.uint16)
    for k in range(ROWS * BANDS):
        out[:, k] = register(np.minimum.reduceat(values * _MULTIPLIERS[k] + _OFFSETS[k], begins))
    return out


@lru_cache(maxsize=4096)
def _chance(log_size: int) -> float:
    """Probability that registers of two disjoint sets of about 2**(log_size / 4) values agree."""
    n = 2.0 ** (log_size / 4)
    zeros = np.arange(64)[:, None]
    cells = np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA)
    low = 2.0 ** -(zeros + 1.0) * (1 + cells)
    high = low + 2.0 ** -(zeros + 1.0 + MANTISSA)
    inside = np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(high, 1 - 1e-16)))
    return float((inside ** 2).sum())


def estimate(equal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard estimates from numbers of equal registers, less those that agree by chance."""
    steps = np.rint(4 * np.log2(np.maximum(sizes, 1))).astype(int)
    by_step = {s: _chance(int(s)) for s in np.unique(steps)}
    chance = np.array([by_step[s] for s in steps])
    return (equal / (ROWS * BANDS) - chance) / (1 - chance)


def _set_digest(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """16 bytes for each set: two sums over independently mixed values."""
    out = np.empty((len(begins), 2), dtype=np.uint64)
    out[:, 0] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), begins)
    out[:, 1] = np.add.reduceat(mix(values ^ np.uint64(0x14057B7EF767814F)), begins)
    return out


def _sets(batches: Iterator[pa.RecordBatch], with_sets: bool) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to (id, node, n, regs), and the set itself if asked for."""
    keep_only()
    for batch in batches:
        for texts in slices(batch.column(1)):
            found = shingles(words(texts))
            counts = found.counts
            filled = np.flatnonzero(counts)
            begins = (np.cumsum(counts) - counts)[filled]
            nodes, regs = [None] * len(texts), [None] * len(texts)
            sets: list = [None] * len(texts)
            if len(filled):
                digest = _set_digest(found.hashes, begins)
                table = None if with_sets else registers(found.hashes, begins)
                for k, row in enumerate(filled):
                    nodes[row] = digest[k].tobytes()
                    if table is not None:
                        regs[row] = table[k].tobytes()
                    else:
                        sets[row] = found.hashes[begins[k]:begins[k] + counts[row]].tobytes()
            columns = [batch.column(0).slice(texts.first_row, len(texts)), pa.array(nodes, pa.binary()),
                       pa.array(counts.astype(np.int64)), pa.array(sets if with_sets else regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "sets" if with_sets else "regs"])


def _schema(docs: DataFrame, doc_id: str, last: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("node", T.BinaryType()),
                         T.StructField("n", T.LongType()), T.StructField(last, T.BinaryType())])


def _sets_of(ids: np.ndarray):
    """Sets of the rows (id, text, hash of the id) that the bitmap lets pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(passes(ids, batch.column(2).to_numpy())))
            if some.num_rows:
                yield from _sets(iter([some]), True)
    return run


def _bands(words_: np.ndarray | None):
    """Rows (node, regs) to (band, node): hashes of four registers and their place; with a bitmap, those in it."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(rows, BANDS)
            bands = mix(regs ^ salt)
            keep = np.ones((rows, BANDS), dtype=bool) if words_ is None else passes(words_, bands.reshape(-1)).reshape(rows, BANDS)
            if words_ is None:
                yield pa.RecordBatch.from_arrays([pa.array(bands.reshape(-1).view(np.int64))], names=["band"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bands[keep].view(np.int64)), batch.column(0).take(pa.array(np.nonzero(keep)[0]))],
                    names=["band", "node"])
    return run


def link_block(sets: list[np.ndarray], regs: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block, or between the two sides of a pair of blocks."""
    sizes = np.array([len(s) for s in sets])
    # Shingles as small numbers; those of a single set meet no other.
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begins = np.cumsum(sizes) - sizes
    mark = np.zeros(ids.max() + 1, dtype=bool)
    label = np.arange(len(sets))
    two = len(np.unique(sides)) > 1
    limit = percent / 100
    least = limit - DEVIATIONS * np.sqrt(limit * (1 - limit) / (ROWS * BANDS))
    edges = []
    for a in range(len(sets) - 1):
        rest = np.arange(a + 1, len(sets))
        rest = rest[(label[rest] != label[a])
                    & (100 * np.minimum(sizes[rest], sizes[a]) >= percent * np.maximum(sizes[rest], sizes[a]))]
        if two:
            rest = rest[sides[rest] != sides[a]]
        if not len(rest):
            continue
        rest = rest[estimate((regs[rest] == regs[a]).sum(1), sizes[rest]) >= least]
        if not len(rest):
            continue
        own = ids[begins[a]:begins[a] + sizes[a]]
        mark[own] = True
        for start in range(0, len(rest), 256):
            some = rest[start:start + 256]
            some = some[label[some] != label[a]]
            if not len(some):
                continue
            flat = np.concatenate([ids[begins[b]:begins[b] + sizes[b]] for b in some])
            common = np.add.reduceat(mark[flat], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            linked = some[100 * common >= percent * (sizes[a] + sizes[some] - common)]
            for b in linked:
                if label[b] != label[a]:
                    label[label == label[b]] = label[a]
                    edges.append((a, int(b)))
        mark[own] = False
    return edges


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def close():
            if len(held) < 2:
                return
            nodes, sides, regs, sets = zip(*held)
            edges = link_block([np.frombuffer(s, np.uint64) for s in sets],
                               np.stack([np.frombuffer(r, np.uint16) for r in regs]), np.array(sides), percent)
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([
                    pa.array([nodes[x] for x in a], pa.binary()), pa.array([nodes[x] for x in b], pa.binary())],
                    names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    yield from close()
                    held, key = [], row[:3]
                held.append(row[3:])
        yield from close()
    return run


def _clusters(nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes that share a band with another, joined along shared bands.

    Bands alone are counted first; nodes travel only with bands that occur twice or more.
    """
    regs = nodes.select("node", "regs")
    shared = staged(regs.mapInArrow(tidied(_bands(None)), "band long").groupBy("band").count().filter("count > 1")
                    .select("band"), "near-bands")
    members = staged(regs.mapInArrow(tidied(_bands(bitmap(shared, "band"))), "band long, node binary")
                     .join(shared, "band", "left_semi"), "near-members")
    low = members.groupBy("band").agg(F.min("node").alias("low"))
    stars = members.join(low, "band").select(F.col("node").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
    return components(stars)


def links(docs: DataFrame, nodes: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """Verified links (a, b) between nodes, as a spanning forest of each block."""
    clusters = staged(_clusters(nodes), "near-clusters")
    wanted = among(nodes, clusters, "node").join(clusters, "node").select("node", "n", "regs", "doc", "root")
    wanted = staged(wanted, "near-candidates")
    # The bitmap spares the texts of all other documents a shuffle.
    ids = bitmap(wanted.select(F.xxhash64("doc").alias("h")), "h")
    sets = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id).alias("h"))
            .mapInArrow(tidied(_sets_of(ids)), _schema(docs, doc_id, "sets")))
    sets = sets.filter("node is not null").select("node", "sets")
    sets = sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    blocks = wanted.groupBy("root").agg(
        F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = wanted.join(blocks, "root").join(sets, "node").withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Block i meets every block j >= i; a cluster of one block only itself.
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "node", F.col("own").alias("side"), "regs", "sets")
    return pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(
        tidied(_verify(percent)), "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, n_shingles, component_id, kept) of every row of ``docs``.

    Texts with ``100 * intersection >= percent * union`` are linked. ``component_id`` is the
    smallest id reachable over links; ``node`` is equal for equal sets.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = staged(narrow.mapInArrow(tidied(lambda b: _sets(b, False)), _schema(docs, doc_id, "regs")), "near-registers")
    nodes = staged(rows.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("regs").alias("regs"),
        F.count("*").alias("copies")), "near-nodes")
    found = staged(links(docs, nodes, percent, doc_id, text), "near-links")
    roots = components(found)
    release(spark)
    own = nodes.select("node", "doc", "copies").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    groups = own.groupBy("root").agg(F.min("doc").alias("component_id"), F.sum("copies").alias("c")).filter("c > 1")
    named = staged(own.join(groups, "root").select("node", "component_id"), "near-groups")
    return rows.select("doc_id", "node", "n").join(named, "node", "left").select(
        "doc_id", "node", F.col("n").alias("n_shingles"),
        F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Of rows that repeat both that id and its set of shingles one stays; rows without id that
    have a group with an id go, other rows without id stay.
    """
    found = near_duplicates(docs, percent, doc_id, text)
    found = staged(found.select("doc_id", "node", "kept"), "near-verdicts")
    gone = staged(found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(doc_id)).distinct(),
                  "near-gone")
    again = staged(found.filter("kept and node is not null and doc_id is not null").groupBy("doc_id", "node").count()
                   .filter("count > 1").select(F.col("doc_id").alias(doc_id)).distinct()
                   .join(gone, doc_id, "left_anti"), "near-repeated")
    # Whole rows are judged where they lie.
    if again.isEmpty():
        return without(docs, gone, doc_id)
    return without(docs, gone.unionByName(again), doc_id).unionByName(
        among(docs, again, doc_id).join(again, doc_id, "left_semi").select(*docs.columns).dropDuplicates([doc_id, text]))
