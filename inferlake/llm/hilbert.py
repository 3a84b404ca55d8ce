"""Hard negatives from candidate blocks in Hilbert order, chosen by zone maps.

Vectors are ordered along a Hilbert curve through a grid of their components, so that neighbours in
the order are neighbours in space. Runs of the order form blocks of ``ZONE_ROWS`` rows, staged as
Parquet with a zone map each: the least and the greatest value of every dimension, and of the label.

For an anchor a, interval arithmetic bounds every inner product in a block: the sum over dimensions of
``a * greatest`` where a is positive and ``a * least`` where it is negative is an upper bound, and the other way
round a lower one. A window (low, high) on the score then needs only blocks whose interval meets it. The
zone maps of up to ``GROUPS`` runs of blocks decide which parts of the table a block of windows is sent
to; the map of each block there decides whether its rows are scored. A window that asks for its first k rows
drops every block whose upper bound is below its k-th score so far.

Mining takes two passes: the first k rows of the anchor's own label, which are its positives, and then for
each positive the first rows of other labels within the window that its score opens.

Defined results, besides those of ``vectors``: rows without a label take no part; anchors that repeat an id are asked
once, with the least (label, vector); candidates that repeat an id are rows of their own, and none of them answers
its own id; a positive with a negative score has an empty window; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as vec
from .tables import staged

ZONE_ROWS = 128
GROUPS = 1_024         # runs of blocks whose zone maps travel with a task: bounds what is sent
FIRST_ROWS = 1_024     # rows that give windows a first lower limit; rows like any other
BITS = 4               # of each component in the Hilbert key

FOUND = "ask long, vec_id long, score long"
OPEN = 2.0 ** 62       # a window's end where it has none


def hilbert_keys(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of small non-negative integers on the Hilbert curve, as bytes that sort by it.

    The axes are transformed bit plane by bit plane, from the highest: a plane's set bits invert, and
    its clear bits exchange, the lower bits of the first axis; then the planes are Gray-decoded and interleaved.
    """
    x = x.astype(np.uint16).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.uint16(1 << level)
        low = np.uint16(q - 1)
        for axis in range(dims):
            is_set = (x[axis] & q) != 0
            swap = np.where(is_set, np.uint16(0), (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    carry = np.zeros(x.shape[1], np.uint16)
    for level in range(bits - 1, 0, -1):
        q = np.uint16(1 << level)
        carry ^= np.where((x[-1] & q) != 0, np.uint16(q - 1), np.uint16(0))
    x ^= carry
    planes = [(x >> np.uint16(level)) & np.uint16(1) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _bounds(a: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the products of the rows of ``a`` with anything in each zone."""
    up, down = np.maximum(a, 0.0), np.minimum(a, 0.0)
    return up @ least.T + down @ greatest.T, up @ greatest.T + down @ least.T


def _label_fits(labels: np.ndarray, same: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """Whether a zone may hold a row of the label (``same``), or one of another."""
    inside = (least <= labels[:, None]) & (labels[:, None] <= greatest)
    only = (least == labels[:, None]) & (labels[:, None] == greatest)
    return np.where(same[:, None], inside, ~only)


class Windows:
    """A block of questions: the first k rows with ``low <= 100 * score <= high`` and a fitting label."""

    WIDTH = 4   # floats of a question: label, same label (1) or another (0), low, high

    def __init__(self, ids: np.ndarray, ints: np.ndarray, floats: np.ndarray, dims: int):
        self.asks, self.anchor = ids.reshape(2, -1)
        self.a = ints.reshape(-1, dims).astype(np.float64)
        facts = floats.reshape(-1, self.WIDTH)
        self.label, self.same = facts[:, 0], facts[:, 1] == 1
        self.low, self.high = facts[:, 2].copy(), facts[:, 3]

    def needs(self, least: np.ndarray, greatest: np.ndarray, label_least: np.ndarray, label_greatest: np.ndarray):
        """(which zones each window needs, their upper bounds)."""
        lower, upper = _bounds(self.a, least, greatest)
        fits = _label_fits(self.label, self.same, label_least, label_greatest)
        return fits & (100.0 * upper >= self.low[:, None]) & (100.0 * lower <= self.high[:, None]), upper


class Zones:
    """The blocks of a shard with their zone maps."""

    def __init__(self, held: list[tuple], dims: int):
        self.ids = [h[0] for h in held]
        self.rows = [h[1].reshape(-1, dims).astype(np.float64) for h in held]
        self.labels = [h[2][2 * dims + 2:] for h in held]
        maps = np.array([h[2][:2 * dims + 2] for h in held])
        self.map = maps[:, :dims], maps[:, dims:2 * dims], maps[:, -2], maps[:, -1]

    def search(self, w: Windows, k: int):
        need, upper = w.needs(*self.map)
        scores = np.full((len(w.asks), k), vec.NO_SCORE)
        found = np.full((len(w.asks), k), np.iinfo(np.int64).max)
        for zone in np.argsort(-np.where(need, upper, -np.inf).max(axis=0), kind="stable"):
            at = np.flatnonzero(need[:, zone] & (100.0 * upper[:, zone] >= w.low))
            if not len(at):
                continue
            got = w.a[at] @ self.rows[zone].T
            fits = (self.labels[zone] == w.label[at][:, None]) == w.same[at][:, None]
            fits &= (100.0 * got >= w.low[at][:, None]) & (100.0 * got <= w.high[at][:, None])
            fits &= self.ids[zone] != w.anchor[at][:, None]
            some = np.flatnonzero(fits.any(axis=1))
            if not len(some):
                continue
            table = np.where(fits[some], got[some], vec.NO_SCORE)
            names = np.where(fits[some], self.ids[zone], np.iinfo(np.int64).max)
            rows = at[some]
            scores[rows], found[rows] = vec.best(scores[rows], found[rows], table, names)
            w.low[rows] = np.maximum(w.low[rows], 100.0 * scores[rows, -1])
        return scores, found


class Store:
    """The staged blocks of a table, and what a search needs to know of them."""

    def __init__(self, rows: DataFrame):
        """``rows``: (id, label, v)."""
        self.rows = rows
        self.n, dims, least, most = rows.agg(
            F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
        self.dims = dims = max(dims or 0, 1)
        self.shards = vec.shard_count(self.n, vec.cores_of(rows))
        low, width = float(least or 0), max(float((most or 0) - (least or 0)) + 1.0, 1.0)

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = vec.matrix(batch.column("v"), dims)
                grid = ((x - low) * ((1 << BITS) / width)).astype(np.int64)
                keys = hilbert_keys(grid)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.tobytes() for k in keys], pa.binary()), batch.column("id"), batch.column("label"),
                     vec.lists(list(x), pa.int32())], names=["place", "id", "label", "v"])

        def zones(number: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            x = vec.matrix(batch.column("v"), dims)
            cuts = [slice(a, a + ZONE_ROWS) for a in range(0, len(ids), ZONE_ROWS)]
            maps = [np.concatenate([x[c].min(axis=0), x[c].max(axis=0), [labels[c].min(), labels[c].max()], labels[c]])
                    for c in cuts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cuts), number)), pa.array(np.arange(len(cuts))),
                 vec.lists([ids[c] for c in cuts], pa.int64()),
                 vec.lists([x[c].reshape(-1) for c in cuts], pa.int32()), vec.lists(maps, pa.float64())],
                names=["shard", "seq", "ids", "ints", "floats"])

        placed = rows.mapInArrow(key, "place binary, id long, label long, v array<int>")
        self.blocks = staged(vec.chunks(placed, ["place", "id"], self.shards, zones, vec.PAGE, vec.SHARD_ROWS), "hilbert-blocks")
        self.first = [(r["id"], r["label"], r["v"]) for r in vec.sample(rows, ["id", "label", "v"], FIRST_ROWS)]
        self._group_maps()

    def _group_maps(self) -> None:
        """Zone maps of at most GROUPS runs of shards; one row for each is collected."""
        dims = self.dims
        top = self.blocks.agg(F.max("shard")).first()[0] or 0
        self.run = (top >> vec.CHUNK_BITS) // GROUPS + 1
        group = F.expr(f"(shard >> {vec.CHUNK_BITS}) div {self.run}")
        cells = self.blocks.select(group.alias("group"), F.posexplode(F.slice("floats", 1, 2 * dims + 2)).alias("place", "x"))
        ends = cells.groupBy("group", "place").agg(F.min("x").alias("least"), F.max("x").alias("most"))
        maps = {r["group"]: np.array(r["ends"]) for r in ends.groupBy("group").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("place", "least", "most"))),   # 2 * dims + 2 numbers
            lambda e: F.when((e["place"] < dims) | (e["place"] == 2 * dims), e["least"]).otherwise(e["most"])).alias("ends")).collect()}
        self.groups = np.array(sorted(maps), np.int64)
        table = np.array([maps[g] for g in self.groups]).reshape(-1, 2 * dims + 2)
        self.group_map = table[:, :dims], table[:, dims:2 * dims], table[:, -2], table[:, -1]
        self.group_of = group

    def first_rows(self, asks: DataFrame, k: int) -> DataFrame:
        """(ask, vec_id, score) of the k best rows in each window.

        ``asks``: (ask, anchor, label, same, low, high, v), ``ask`` unique; the label is compared by
        ``same``, and the ends are on 100 times the score.
        """
        dims, groups, maps = self.dims, self.groups, self.group_map
        held = self.first

        def block(number: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """A block of windows, their lower ends raised by the rows that every task knows."""
            x = vec.matrix(batch.column("v"), dims)
            facts = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
                                     for c in ("label", "same", "low", "high")])
            ids = np.concatenate([batch.column("ask").to_numpy(), batch.column("anchor").to_numpy()])
            ints = x.reshape(-1)
            w = Windows(ids, ints, facts.reshape(-1), dims)
            if held:
                rows = np.zeros((len(held), dims))
                for at, (_, _, v) in enumerate(held):
                    rows[at, :len(v)] = v
                got = 100.0 * (w.a @ rows.T)
                fits = (np.array([h[1] for h in held]) == w.label[:, None]) == w.same[:, None]
                fits &= (got >= w.low[:, None]) & (got <= w.high[:, None])
                fits &= np.array([h[0] for h in held]) != w.anchor[:, None]
                if len(held) >= k:
                    facts[:, 2] = np.maximum(facts[:, 2], np.sort(np.where(fits, got, -OPEN), axis=1)[:, -k])
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), vec.lists([ids], pa.int64()), vec.lists([ints], pa.int32()),
                 vec.lists([facts.reshape(-1)], pa.float64())], names=["seq", "ids", "ints", "floats"])

        shape = "seq long, ids array<long>, ints array<int>, floats array<double>"
        count = asks.count()
        parts = max(1, min(vec.cores_of(asks), -(-count // vec.BLOCK)))
        blocks = staged(vec.chunks(asks.select("ask", "anchor", "label", "same", "low", "high", "v"), ["ask"], parts, block, shape, vec.BLOCK),
                        "hilbert-asks")

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    w = Windows(*(batch.column(c)[at].values.to_numpy() for c in ("ids", "ints", "floats")), dims)
                    chosen = groups[w.needs(*maps)[0].any(axis=0)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(chosen), batch.column("seq")[at].as_py())), pa.array(chosen)], names=["seq", "group"])

        pairs = blocks.mapInArrow(choose, "seq long, group long")
        shards = self.blocks.select(self.group_of.alias("group"), "shard").distinct()
        sent = pairs.join(shards, "group").select("seq", "shard").join(blocks, "seq")

        def open_shard(pages: list[tuple]) -> Zones:
            return Zones(pages, dims)

        def answer(zones: Zones, ids: np.ndarray, ints: np.ndarray, floats: np.ndarray) -> Iterator[pa.RecordBatch]:
            w = Windows(ids, ints, floats, dims)
            scores, found = zones.search(w, k)
            who, slot = np.nonzero(scores > vec.NO_SCORE)
            if len(who):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.asks[who]), pa.array(found[who, slot]), pa.array(scores[who, slot].astype(np.int64))],
                    names=["ask", "vec_id", "score"])

        partial = vec.visit(self.blocks, sent, open_shard, answer, FOUND, self.shards, -(-count // vec.BLOCK))
        order = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id")
        return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 5,
                   least_percent: int = 80, scale: int = 256, vec_id: str = "vec_id",
                   vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row that ``anchor`` marks and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of another label that score between ``least_percent`` percent of the positive's score and that score.
    """
    source = df.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"),
                       F.col(vector).alias("x"), anchor.alias("asked"))
    rows = source.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & vec.usable(F.col("x"))).select(
        "id", "label", vec.scaled(F.col("x"), scale).alias("v"), F.coalesce("asked", F.lit(False)).alias("asked"))
    rows = staged(rows, "hilbert-rows")
    store = Store(rows.select("id", "label", "v"))
    anchors = (rows.filter("asked").groupBy("id").agg(F.min(F.struct("label", "v")).alias("a"))
               .select(F.col("id").alias("anchor"), "a.label", "a.v"))

    def window(same: int, low: Column, high: Column) -> list[Column]:
        return ["anchor", "label", F.lit(same).alias("same"), low.cast("double").alias("low"), high.cast("double").alias("high"), "v"]

    own = anchors.select(F.col("anchor").alias("ask"), *window(1, F.lit(-OPEN), F.lit(OPEN)))
    near = store.first_rows(own, positives).select(
        F.col("ask").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # one number for each (anchor, positive), fixed by staging
    near = staged(near.withColumn("ask", F.monotonically_increasing_id()), "hilbert-positives")
    opened = near.filter("positive_score >= 0").join(anchors, "anchor").select(
        "ask", *window(0, F.col("positive_score") * least_percent, F.col("positive_score") * 100))
    found = store.first_rows(opened, negatives)
    return found.join(near, "ask").select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
