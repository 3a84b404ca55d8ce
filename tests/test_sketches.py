"""Sketched profiles against exact ones, and stores that grow with their table."""

import pytest
from pyspark.sql import functions as F

from inferlake.operators.profile import column_profile, text_column_choice
from inferlake.operators.sketches import RELATIVE_ERROR, column_sketches, merge_sketches, sketch_profile
from inferlake.plans import profiles
from inferlake.spec import SpecError


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def close(got, want, *keys):
    """Exact fields agree; the estimate, which depends on how parts were merged, is near the true number."""
    def parts(df):
        exact = [*keys, "ordinal", "name", "avg_len", "n_rows"]
        return {tuple(r[c] for c in exact): r["n_distinct"] for r in df.collect()}
    a, b = parts(got), parts(want)
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) <= b[k] * RELATIVE_ERROR for k in a)


def sample(spark, first, last):
    return spark.range(first, last).select(
        "id", F.concat(F.lit("é"), F.col("id") % 4001).alias("text"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "").alias("few"),
        F.concat(F.lit("s"), F.col("id") % 2).alias("split"))


def test_sketch_against_exact(spark):
    df = sample(spark, 0, 30_000)
    got = {r["name"]: r for r in sketch_profile(column_sketches(df)).collect()}
    want = {r["name"]: r for r in column_profile(df).collect()}
    assert {n: (r.ordinal, r.avg_len) for n, r in got.items()} == {n: (r.ordinal, r.avg_len) for n, r in want.items()}
    assert abs(got["text"].n_distinct - 4001) <= 4001 * RELATIVE_ERROR
    assert got["few"].n_distinct == 2 and got["split"].n_distinct == 2      # null counts as ""
    assert text_column_choice(sketch_profile(column_sketches(df.drop("text")))).head().source == "detected"


def test_parts_merge_to_the_whole(spark):
    parts = [column_sketches(sample(spark, a, a + 5000)) for a in (0, 3000, 9000)]
    merged = merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    got = {r["name"]: r for r in sketch_profile(merged).collect()}
    assert got["text"].n_rows == 15_000 and abs(got["text"].n_distinct - 4001) <= 4001 * RELATIVE_ERROR


def test_no_shuffle_of_values(spark, plan_of):
    plan = plan_of(column_sketches(sample(spark, 0, 100)))
    assert plan.count("Exchange") == 1 and "Expand" not in plan


def test_no_rows_no_string_columns_and_odd_names(spark):
    assert column_sketches(sample(spark, 0, 0)).collect() == []
    assert column_sketches(spark.range(3)).collect() == []
    odd = spark.createDataFrame([("x", "y")], "`a.b` string, `_rows_` string")
    assert {r["name"] for r in column_sketches(odd).collect()} == {"a.b", "_rows_"}
    with pytest.raises(ValueError):
        column_sketches(sample(spark, 0, 3).withColumnRenamed("split", "name"), by=["name"])


def test_new_files_alone_are_read(spark, tmp_path):
    path, store = str(tmp_path / "t"), str(tmp_path / "store")
    sample(spark, 0, 4000).repartition(3).write.parquet(path)
    assert profiles.update_profile(spark, spark.read.parquet(path), store, by=["split"]) == 3
    assert profiles.update_profile(spark, spark.read.parquet(path), store, by=["split"]) == 0
    sample(spark, 4000, 6000).repartition(2).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    with pytest.raises(SpecError):
        profiles.kept_profile(spark, df, store)
    assert profiles.update_profile(spark, df, store, by=["split"]) == 2
    kept = profiles.kept_profile(spark, df, store)
    direct = sketch_profile(column_sketches(df, ["text", "few"]))
    assert close(kept, direct)
    assert "part-" not in "".join(f for f in kept.inputFiles() if "/store/" not in f)   # no file of the table
    by_split = profiles.kept_profile(spark, df, store, by_split=True)
    assert close(by_split, sketch_profile(column_sketches(df, ["text", "few"], ["split"]), ["split"]), "split")


def test_files_that_go_change_or_come_back_count_once(spark, tmp_path):
    path, aside, store = tmp_path / "t", tmp_path / "aside", str(tmp_path / "store")
    sample(spark, 0, 900).repartition(3).write.parquet(str(path))
    aside.mkdir()

    def check():
        df = spark.read.parquet(str(path))
        profiles.update_profile(spark, df, store)
        assert rows_of(profiles.kept_profile(spark, df, store)) == rows_of(sketch_profile(column_sketches(df)))

    check()
    gone = sorted(path.glob("part-*.parquet"))[0]
    gone.rename(aside / gone.name)
    check()
    (aside / gone.name).rename(gone)
    check()
    sample(spark, 5000, 5100).coalesce(1).write.parquet(str(tmp_path / "other"))
    gone.write_bytes(next((tmp_path / "other").glob("part-*.parquet")).read_bytes())
    for crc in path.glob(".*.crc"):
        crc.unlink()
    check()
    check()


def test_a_crash_before_the_ledger_leaves_nothing(spark, tmp_path):
    path, store = str(tmp_path / "t"), tmp_path / "store"
    sample(spark, 0, 300).write.parquet(path)
    df = spark.read.parquet(path)
    profiles.update_profile(spark, df, str(store))
    (store / "files-0000" / "_SUCCESS").unlink()
    with pytest.raises(SpecError):
        profiles.kept_profile(spark, df, str(store))
    profiles.update_profile(spark, df, str(store))
    assert {r.n_rows for r in profiles.kept_profile(spark, df, str(store)).collect()} == {300}


def test_refusals(spark, tmp_path):
    path, store = str(tmp_path / "t"), str(tmp_path / "store")
    sample(spark, 0, 10).write.parquet(path)
    df = spark.read.parquet(path)
    profiles.update_profile(spark, df, store)
    with pytest.raises(SpecError):
        profiles.update_profile(spark, df, store, ["text"])
    with pytest.raises(SpecError):
        profiles.update_profile(spark, sample(spark, 0, 3), store)
