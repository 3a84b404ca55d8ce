"""The vector searches against brute force, on hot groups and edge rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inferlake.llm import hilbert, mtree, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string, shard int, asked int, score int"
CLASH = (1, "v", 2, 3, 4)


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(5)


def hot(n=700, dims=6):
    """A third of the rows are one vector, a third lies close to it, the others are spread."""
    pick = np.random.default_rng(5)
    base = pick.normal(size=dims)
    out = []
    for k in range(n):
        x = base if k % 3 == 0 else base + pick.normal(size=dims) * 0.01 if k % 3 == 1 else pick.normal(size=dims) * 3
        out.append((k, [float(np.float32(c)) for c in x], k % 4 if k % 3 else 1))
    random.Random(1).shuffle(out)
    return out


def edges():
    return [(0, [0.5, -0.5], 1), (20, None, 1), (40, [1.0, None], 2), (60, [float("nan"), 1.0], 2), (80, [float("inf"), 0.0], 1),
            (None, [1.0, 1.0], 1), (100, [], 1), (1, [0.5, -0.5], 1), (2, [0.5], 2), (2, [0.5], 2), (3, [0.5, 0.5, 0.5], None),
            (700, [0.25, -0.25, 1.0], 2), (700, [0.25, -0.25, 1.0], 2), (5, [0.5, -0.5], 3), (6, [-0.5, 0.5], 1)]


def usable(rows, scale, labelled=False):
    return [(i, [np.floor(scale * float(x)) for x in v], label) for i, v, label in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
            and (label is not None or not labelled)]


def dot(a, b):
    return int(sum(x * y for x, y in zip(a, b)))


def brute_top(rows, every, k):
    found = set()
    rows = usable(rows, 64)
    for i, q, _ in rows:
        if i % every == 0:
            order = sorted((-dot(q, v), j) for j, v, _ in rows if j != i)[:k]
            found |= {(i, rank, j, -score) for rank, (score, j) in enumerate(order, 1)}
    return found


def brute_negatives(rows, every):
    found = set()
    rows = usable(rows, 256, labelled=True)
    for i, q, label in rows:
        if i % every:
            continue
        scored = [(dot(q, v), j, other) for j, v, other in rows if j != i]
        near = sorted((-s, j) for s, j, other in scored if other == label)[:5]
        for at, (minus, positive) in enumerate(near):
            inside = sorted((-s, j) for s, j, other in scored
                            if other != label and 80 * -minus <= 100 * s <= 100 * -minus)[:5]
            found |= {(i, at, positive, rank, j, -minus, -s) for rank, (s, j) in enumerate(inside, 1)}
    return {(i, p, r, j, ps, ns) for i, _, p, r, j, ps, ns in found}


@pytest.fixture
def small(monkeypatch):
    """Shards, pages and blocks of a few rows, so that every level has several."""
    for name, size in (("SHARD_ROWS", 50), ("LEAST_ROWS", 20), ("BLOCK", 4), ("VISITS", 2)):
        monkeypatch.setattr(vectors, name, size)
    monkeypatch.setattr(mtree, "PAGE_ROWS", 8)
    monkeypatch.setattr(mtree, "ROOT_ROWS", 40)
    monkeypatch.setattr(hilbert, "ZONE_ROWS", 7)
    monkeypatch.setattr(hilbert, "GROUPS", 3)
    monkeypatch.setattr(hilbert, "FIRST_ROWS", 30)


@pytest.mark.parametrize("rows", [hot(), edges()], ids=["hot", "edges"])
def test_top_k(spark, small, rows):
    got = mtree.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, k=7).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 20, 7)


@pytest.mark.parametrize("rows", [hot(), edges()], ids=["hot", "edges"])
def test_hard_negatives(spark, small, rows):
    got = hilbert.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, F.col("label")).collect()
    assert {tuple(r) for r in got} == brute_negatives(rows, 100)


def test_empty_tables(spark):
    nothing = table(spark, edges()).limit(0)
    assert mtree.top_k(nothing, F.col("vec_id") % 20 == 0).count() == 0
    assert hilbert.hard_negatives(nothing, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_string_ids_of_numbers_and_large_ids(spark):
    rows = [(2 ** 62 + 20 * k, [k / 10, 1.0], k % 2) for k in range(12)]
    df = table(spark, rows)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_k(df, F.lit(True), k=3).collect()}
    want = set()
    for i, q, _ in usable(rows, 64):
        order = sorted((-dot(q, v), j) for j, v, _ in usable(rows, 64) if j != i)[:3]
        want |= {(i, n, j, -s) for n, (s, j) in enumerate(order, 1)}
    assert got == want
    mined = hilbert.hard_negatives(df, F.col("vec_id") == 2 ** 62, F.col("label")).collect()
    assert mined and all(r.negative_id != r.anchor_id for r in mined)


def test_pages_spare_distances():
    """Rows near a query are found without scoring the pages of a far cluster."""
    pick = np.random.default_rng(2)
    x = np.rint(np.concatenate([pick.normal(size=(640, 8)) * 3 + 400 * side for side in (-1, 1)])).astype(np.int32)
    longest = float((x.astype(float) ** 2).sum(axis=1).max())
    lifted = mtree._lifted(x, longest)
    pages = []
    for at in mtree._pages(lifted):
        away = mtree._distances(lifted[at], lifted[at[:1]])[:, 0]
        parent = mtree._distances(lifted[at[:1]], lifted[:1])[0, 0]
        pages.append((at.astype(np.int64), x[at].reshape(-1), np.concatenate([[0, away.max(), parent, 0], away])))
    shard = mtree.Shard(pages, lifted[:1], 8, longest)
    scored = []
    real = np.einsum

    def counting(path, *parts):
        if path == "ij,ij->i" and parts[0].shape[1] == 8:
            scored.append(len(parts[0]))
        return real(path, *parts)

    np.einsum = counting
    try:
        scores, ids = shard.search(np.array([-1]), x[:1].astype(float), np.array([vectors.NO_SCORE]), 5)
    finally:
        np.einsum = real
    products = x.astype(np.int64) @ x[0].astype(np.int64)
    order = np.lexsort((np.arange(len(x)), -products))[:5]
    assert list(ids[0]) == list(order) and list(scores[0]) == list(products[order])
    assert sum(scored) < len(x) / 2


def test_hilbert_order_is_a_curve():
    """All cells of a grid once, and neighbours in the order differ by one step."""
    for dims, bits in ((2, 3), (3, 2), (2, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = [k.tobytes() for k in hilbert.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_product():
    pick = np.random.default_rng(3)
    rows, asks = pick.integers(-50, 50, (40, 5)), pick.integers(-50, 50, (9, 5)).astype(float)
    low, high = hilbert._bounds(asks, rows.min(axis=0)[None].astype(float), rows.max(axis=0)[None].astype(float))
    products = asks @ rows.T
    assert (low[:, 0] <= products.min(axis=1)).all() and (high[:, 0] >= products.max(axis=1)).all()
