import random

import pytest
from pyspark.sql import functions as F

from inferlake.operators.batching import explode_batches, micro_batch
from inferlake.operators.rowindex import DuplicateIdError, build_index
from inferlake.sources import tables


def numbered(df, id_column, **options):
    index = build_index(df, id_column, **options)
    return index, {r[id_column]: r["idx"] for r in index.attach(df).collect()}


@pytest.mark.parametrize("kind", ["dense", "outliers", "strings"])
def test_numbers_follow_id_order(spark, kind):
    rng = random.Random(3)
    if kind == "dense":
        ids = list(range(1000))
    elif kind == "outliers":   # nearly all ids crowd one corner of the range
        ids = list(range(900)) + [10**12 + i * 10**9 for i in range(50)] + [-(10**15)]
    else:
        ids = list({"".join(rng.choices("abé'\"\\/ 日", k=rng.randint(1, 9))) for _ in range(800)})
    rng.shuffle(ids)
    schema = "id string" if kind == "strings" else "id bigint"
    df = spark.createDataFrame([(i,) for i in ids], schema).repartition(5)
    index, got = numbered(df, "id", slice_rows=20)
    order = sorted(ids, key=lambda s: s.encode()) if kind == "strings" else sorted(ids)
    assert got == {v: i for i, v in enumerate(order)}
    assert index.total == len(ids)
    assert {r["id"]: r["idx"] for r in index.table.collect()} == got


def test_slices_hold_exactly_chunk_rows(spark):
    df = spark.range(10_007).withColumn("id", F.col("id") * F.col("id"))
    index = build_index(df, "id", align=64, slice_rows=100)
    sizes = [r["count"] for r in index.attach(df).groupBy("slice_no").count()
             .orderBy("slice_no").collect()]
    assert index.chunk % 64 == 0
    assert set(sizes[:-1]) == {index.chunk} and sum(sizes) == 10_007


def test_empty_and_single(spark):
    df = spark.range(0).toDF("id")
    assert numbered(df, "id")[1] == {}
    assert numbered(spark.range(1).toDF("id"), "id")[1] == {0: 0}


@pytest.mark.parametrize("ids", [[1, 2, 2, 3], [1, None, 2]])
def test_ids_must_be_unique_and_present(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    with pytest.raises(DuplicateIdError):
        build_index(df, "id")


def test_no_single_partition_window(spark, plan_of):
    df = spark.range(5000).toDF("id")
    plan = plan_of(build_index(df, "id").attach(df))
    assert "SinglePartition" not in plan and "Window" not in plan
    assert plan.count("Exchange") == 1


def test_wide_rows_are_scanned_once(spark, plan_of, tmp_path):
    """The text is in one scan only, and each slice is a partition of its own."""
    path = str(tmp_path / "t")
    wide = spark.range(20_000).select((F.col("id") * 7).alias("id"), F.repeat(F.lit("x"), 50).alias("text"))
    wide.repartition(6).write.parquet(path)
    df = spark.read.parquet(path)
    index = build_index(df, "id", align=64, slice_rows=1000)
    got = index.attach(df)
    plan = plan_of(got)
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert got.rdd.getNumPartitions() == index.slices
    rows = got.select("slice_no", "idx", F.spark_partition_id().alias("p"), (F.col("id") / 7).alias("want")).collect()
    assert all(r.idx == r.want and r.p == r.slice_no == r.idx // index.chunk for r in rows)


def test_numbers_hold_when_partitions_are_merged_later(spark):
    """A later operator may merge partitions; the numbers were given before."""
    df = spark.range(5000).select((F.col("id") * 3).alias("id"))
    got = build_index(df, "id", slice_rows=100).attach(df)
    assert got.coalesce(2).where("idx * 3 <> id").count() == 0
    assert got.limit(77).where("idx * 3 <> id").count() == 0


@pytest.mark.parametrize("slice_rows", [1, 2, 3, 64])
def test_binary_search_at_every_count_of_starts(spark, slice_rows):
    for n in (1, 2, 3, 5, 8, 9, 33):
        df = spark.range(n).select((F.col("id") * 2 - 7).alias("id"))
        index, got = numbered(df, "id", slice_rows=slice_rows)
        assert got == {2 * i - 7: i for i in range(n)}


def test_batches_move_the_text_once(spark, plan_of):
    df = spark.range(5000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    plan = plan_of(micro_batch(df, "id", "text", 64))
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("n,batch", [(1, 64), (64, 64), (65, 64), (1000, 7), (130, 1)])
def test_batches_against_python(spark, n, batch):
    ids = random.Random(n).sample(range(10 * n), n)
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "id bigint, text string")
    units = micro_batch(df.repartition(3), "id", "text", batch)
    got = {r["row_id"]: (r["batch_no"], r["member_ids"], r["texts"]) for r in units.collect()}
    order, want = sorted(ids), {}
    for no, start in enumerate(range(0, n, batch)):
        members = order[start:start + batch]
        want[f"b-{members[0]}"] = (no, members, [f"text {i}" for i in members])
    assert got == want
    assert explode_batches(units, "texts").count() == n


def test_limit_is_a_pushed_filter(spark, plan_of, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3000).select((F.col("id") * 3).alias("id")).repartition(4).write.parquet(path)
    df = tables.first_rows(spark.read.parquet(path), "id", 1234)
    assert sorted(r["id"] for r in df.collect()) == [3 * i for i in range(1234)]
    assert "LessThanOrEqual(id,3699)" in plan_of(df)
    assert tables.first_rows(spark.read.parquet(path), "id", 9999).count() == 3000
