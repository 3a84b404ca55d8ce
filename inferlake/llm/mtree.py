"""Exact top-k inner products by best-first search in an M-tree.

Inner products become distances by one more coordinate: with ``e(x) = sqrt(M - |x|^2)``, M the
greatest squared length, ``|(q, 0) - (x, e(x))|^2 = |q|^2 + M - 2 q.x``, so the nearest rows are those
with the highest products, and the triangle inequality holds.

The tree has three levels. The root's routing objects are up to ``ROOTS`` rows of the table; every row
belongs to the nearest. Below it, rows in the order of (routing object, distance) form shards, whose
entries keep the range of these distances. A shard is cut into pages of at most ``PAGE_ROWS`` rows by
promoting two distant rows and halving between them; a page keeps its routing object (one of its rows),
covering radius, distance to the parent, and each row's distance to the routing object. Pages are staged
as a table, and every row is in one of them.

A query knows a lower limit of its k-th score from the root objects, which are rows themselves. The
limit is a ball; it reaches the shards whose range of parent distances it meets. There, the stored
distance to the parent rules pages out before their distance is computed, the covering radius
rules out more, the remaining pages are visited by ascending bound, each query on its own, and stored
distances rule out rows of a page. A query ends when its next bound is beyond its k-th score. Queries of a
block advance together, a page each, as one numpy step.

Defined results, besides those of ``vectors``: queries that repeat an id are asked once, with the least
of their vectors; candidates that repeat an id are rows of their own, and none of them answers its own id;
a table without k other rows gives all it has; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as vec
from .tables import staged

ROOTS = 1_024        # root entries, chosen among the rows: a documented bound, not a sample of what is found
ROOT_ROWS = 64       # rows behind a root entry, at least
PAGE_ROWS = 64
SLACK = 1e-5         # of the longest possible distance: far above the rounding of distances
FIXED = 4            # numbers before the distances in a page: routing row, radius, to parent, root entry

FOUND = "query_id long, vec_id long, score long"


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the coordinate that turns products into distances."""
    x = x.astype(np.float64)
    rest = np.maximum(longest - np.einsum("ij,ij->i", x, x), 0.0)
    return np.hstack([x, np.sqrt(rest)[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _as_queries(q: np.ndarray) -> np.ndarray:
    return np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])


def _pages(x: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the rows of each page: two distant rows are promoted, and the half that is nearer to one
    of them is parted from the other half, until pages are small enough."""
    open_nodes = [np.arange(len(x))]
    while open_nodes:
        at = open_nodes.pop()
        if len(at) <= PAGE_ROWS:
            yield at
            continue
        rows = x[at]
        first = int(np.argmax(_distances(rows[:1], rows)[0]))
        to_first = _distances(rows[first:first + 1], rows)[0]
        second = int(np.argmax(to_first))
        side = to_first - _distances(rows[second:second + 1], rows)[0]
        order = np.argsort(side, kind="stable")
        half = len(at) // 2
        open_nodes += [at[order[:half]], at[order[half:]]]


class Shard:
    """The pages of a shard, and what is stored with them."""

    def __init__(self, pages: list[tuple], roots: np.ndarray, dims: int, longest: float):
        sizes = np.array([len(ids) for ids, _, _ in pages])
        first = np.cumsum(sizes) - sizes
        width = int(sizes.max())
        #: pages as rows of one table of places; -1 where a page is shorter
        self.place = np.where(np.arange(width) < sizes[:, None], first[:, None] + np.arange(width), -1)
        self.ids = np.concatenate([p[0] for p in pages])
        self.rows = np.concatenate([p[1].reshape(-1, dims) for p in pages]).astype(np.float64)
        head = np.array([p[2][:FIXED] for p in pages])
        self.routing = _lifted(self.rows[first + head[:, 0].astype(int)], longest)
        self.radius, self.to_parent = head[:, 1], head[:, 2]
        self.to_routing = np.concatenate([p[2][FIXED:] for p in pages])
        used, self.parent = np.unique(head[:, 3].astype(int), return_inverse=True)
        self.roots = roots[used]
        self.longest = longest

    def search(self, ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int):
        """(scores, ids) of the k best of each query here, as far as they reach its limit."""
        n, pages = len(ids), len(self.radius)
        lifted = _as_queries(queries)
        reach = np.einsum("ij,ij->i", lifted, lifted) + self.longest      # at score 0, squared
        slack = SLACK * np.sqrt(reach) + 1e-9

        def ball(score, at=slice(None)):
            return np.sqrt(np.maximum(reach[at] - 2.0 * score, 0.0)) + slack[at]

        scores = np.full((n, k), vec.NO_SCORE)
        found = np.full((n, k), np.iinfo(np.int64).max)
        radius = ball(limits)
        to_root = _distances(lifted, self.roots)
        # the stored distance to the parent: no distance of the page itself is computed yet
        apart = np.abs(to_root[:, self.parent] - self.to_parent) - self.radius
        near = apart <= radius[:, None]
        some = np.flatnonzero(near.any(axis=0))
        to_page = np.full((n, pages), np.inf)
        if len(some):
            to_page[:, some] = _distances(lifted, self.routing[some])
        bound = np.where(near, np.maximum(to_page - self.radius, 0.0), np.inf)
        order = np.argsort(bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        live = np.arange(n)
        for step in range(pages):
            live = live[bound[live, step] <= radius[live]]
            if not len(live):
                break
            page = order[live, step]
            place = self.place[page]                                     # a page of each live query
            hope = place >= 0
            hope &= np.abs(to_page[live, page][:, None] - self.to_routing[place]) <= radius[live][:, None]
            hope &= self.ids[place] != ids[live][:, None]
            who, slot = np.nonzero(hope)
            if not len(who):
                continue
            rows = place[who, slot]
            got = np.einsum("ij,ij->i", self.rows[rows], queries[live[who]])
            good = got >= limits[live[who]]
            if not good.any():
                continue
            table = np.full(hope.shape, vec.NO_SCORE)
            table[who[good], slot[good]] = got[good]
            names = np.where(table > vec.NO_SCORE, self.ids[place], np.iinfo(np.int64).max)
            better = np.unique(who[good])
            at = live[better]
            scores[at], found[at] = vec.best(scores[at], found[at], table[better], names[better])
            limits[at] = np.maximum(limits[at], scores[at, -1])
            radius[at] = ball(limits[at], at)
        return scores, found


def top_k(df: DataFrame, query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row that ``query``
    marks with the other rows of ``df``."""
    # the search's own table, so that column names of the input can't clash
    source = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("x"), query.alias("asked"))
    rows = source.filter(F.col("id").isNotNull() & vec.usable(F.col("x"))).select(
        "id", vec.scaled(F.col("x"), scale).alias("v"), F.coalesce("asked", F.lit(False)).alias("asked"))
    rows = staged(rows, "mtree-rows")
    length = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    n, dims, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(length)).first()
    if not n or not dims:
        dims, longest = max(dims or 0, 1), longest or 0
    picked = vec.sample(rows, ["id", "v"], min(ROOTS, -(-n // ROOT_ROWS)))
    root_ids = np.array([r["id"] for r in picked], np.int64)
    root_rows = np.zeros((len(picked), dims), np.int32)
    for at, r in enumerate(picked):
        root_rows[at, :len(r["v"])] = r["v"]
    lifted_roots = _lifted(root_rows, longest)
    cores = vec.cores_of(rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vec.matrix(batch.column("v"), dims)
            away = _distances(_lifted(x, longest), lifted_roots)
            cell = np.argmin(away, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), vec.lists(list(x), pa.int32()), pa.array(cell.astype(np.int32)),
                 pa.array(away[np.arange(len(x)), cell])], names=["id", "v", "cell", "away"])

    def grow(number: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The pages of one shard."""
        ids, cells = batch.column("id").to_numpy(), batch.column("cell").to_numpy()
        away, x = batch.column("away").to_numpy(), vec.matrix(batch.column("v"), dims)
        lifted = _lifted(x, longest)
        out_ids, out_rows, out_floats = [], [], []
        for cell in np.unique(cells):
            own = np.flatnonzero(cells == cell)
            for places in _pages(lifted[own]):
                at = own[places]
                middle = lifted[at].mean(axis=0)
                routing = int(np.argmin(((lifted[at] - middle) ** 2).sum(axis=1)))
                to_routing = _distances(lifted[at], lifted[at[routing]][None])[:, 0]
                out_ids.append(ids[at])
                out_rows.append(x[at].reshape(-1))
                out_floats.append(np.concatenate([
                    [routing, to_routing.max(), away[at[routing]], cell], to_routing]))
        count = len(out_ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(count, number)), pa.array(np.arange(count)), vec.lists(out_ids, pa.int64()),
             vec.lists(out_rows, pa.int32()), vec.lists(out_floats, pa.float64())],
            names=["shard", "seq", "ids", "ints", "floats"])

    routed = "id long, v array<int>, cell int, away double"
    shards = vec.shard_count(n, cores)
    pages = staged(vec.chunks(rows.select("id", "v").mapInArrow(route, routed), ["cell", "away", "id"], shards, grow,
                              vec.PAGE, vec.SHARD_ROWS), "mtree-pages")
    entries = pages.groupBy("shard", F.get("floats", F.lit(3)).cast("int").alias("cell")).agg(
        F.min(F.get("floats", F.lit(2)) - F.get("floats", F.lit(1))).alias("least"),
        F.max(F.get("floats", F.lit(2)) + F.get("floats", F.lit(1))).alias("most"))

    asked = rows.filter("asked").groupBy("id").agg(F.min("v").alias("v"))

    def limit(number: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A block of queries with lower limits of their k-th scores, from the root objects."""
        ids, x = batch.column("id").to_numpy(), vec.matrix(batch.column("v"), dims)
        limits = np.full(len(ids), vec.NO_SCORE)
        scores = x.astype(np.float64) @ root_rows.T.astype(np.float64)
        scores[ids[:, None] == root_ids] = vec.NO_SCORE
        if scores.shape[1] >= k:
            limits = np.sort(scores, axis=1)[:, -k]
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), vec.lists([ids], pa.int64()), vec.lists([x.reshape(-1)], pa.int32()),
             vec.lists([limits], pa.float64())], names=["seq", "ids", "ints", "floats"])

    parts = max(1, min(cores, -(-n // (20 * vec.BLOCK))))
    blocks = staged(vec.chunks(asked.mapInArrow(route, routed), ["cell", "away", "id"], parts, limit,
                               "seq long, ids array<long>, ints array<int>, floats array<double>", vec.BLOCK), "mtree-asks")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block and root entry, the distances from the entry that its queries' balls cover."""
        for batch in batches:
            for at in range(batch.num_rows):
                limits = batch.column("floats")[at].values.to_numpy()
                q = _as_queries(batch.column("ints")[at].values.to_numpy().reshape(-1, dims))
                square = np.einsum("ij,ij->i", q, q) + longest
                radius = np.sqrt(np.maximum(square - 2.0 * limits, 0.0)) + SLACK * np.sqrt(square) + 1e-9
                away = _distances(q, lifted_roots)
                count = away.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(count, batch.column("seq")[at].as_py())), pa.array(np.arange(count, dtype=np.int32)),
                     pa.array((away - radius[:, None]).min(axis=0)), pa.array((away + radius[:, None]).max(axis=0))],
                    names=["seq", "cell", "low", "high"])

    wanted = blocks.select("seq", "ints", "floats").mapInArrow(reach, "seq long, cell int, low double, high double")
    pairs = (wanted.join(entries, "cell").filter("low <= most and high >= least").select("shard", "seq").distinct())

    def open_shard(held: list[tuple]) -> Shard:
        return Shard(held, lifted_roots, dims, longest)

    def answer(shard: Shard, ids: np.ndarray, ints: np.ndarray, limits: np.ndarray) -> Iterator[pa.RecordBatch]:
        scores, found = shard.search(ids, ints.reshape(-1, dims).astype(np.float64), limits.copy(), k)
        who, slot = np.nonzero(scores > vec.NO_SCORE)
        if len(who):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[who]), pa.array(found[who, slot]), pa.array(scores[who, slot].astype(np.int64))],
                names=["query_id", "vec_id", "score"])

    partial = vec.visit(pages, pairs.join(blocks, "seq"), open_shard, answer, FOUND, shards, -(-n // (20 * vec.BLOCK)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
