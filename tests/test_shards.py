"""Commits, shards that run on their own, sources that grow, and reads through deletion vectors."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from inferlake import SpecError, embed, generate, launch
from inferlake.models import build
from inferlake.operators import healing
from inferlake.operators.rowindex import DuplicateIdError
from inferlake.plans import runs
from inferlake.sources import claims, sinks
from inferlake.sources.storage import create_new


@pytest.fixture
def docs(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(i, f"text {i} {'omega' if i % 10 == 3 else ''}") for i in range(60)]
    spark.createDataFrame(rows, "id bigint, text string").repartition(3).write.parquet(path)
    return path


OPTIONS = dict(id_column="id", column="text", batch=4, world=3, wave_units=8)


def texts(run):
    return sorted(t for r in run.results().select("texts").collect() for t in r.texts)


def test_counts_are_observed_while_a_part_is_written(spark, docs, tmp_path, monkeypatch):
    """No part and no sidecar is read for counts, ticks and stats: only ids are, for the sidecar."""
    scans = []
    real = sinks.log_part
    monkeypatch.setattr(sinks, "log_part", lambda *a: scans.append(a) or real(*a))
    monkeypatch.setattr(sinks, "read_sidecar", None)
    out = str(tmp_path / "out")
    run = embed(spark, docs, output=out, factory=build("faulty", {"raise_on": "omega"}), **OPTIONS)
    assert scans == []
    seen = sinks.log_counts(spark, out).groupBy("wave", "rank").agg(F.sum("units"), F.sum("ok"), F.sum("prompt_tokens"))
    want = sinks.read_parts(spark, out).groupBy("wave", "rank").agg(
        F.count(F.lit(1)), F.count_if(F.col("error").isNull()), F.coalesce(F.sum("prompt_tokens"), F.lit(0)))
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, want.collect()))
    failed = sum(r.rows_failed for r in run.status().stats.collect())
    assert failed == run.results(include_errors=True).where("error is not null").count() > 0


def test_the_write_scans_its_units_once(spark, docs, tmp_path, plan_of):
    plan = embed(spark, docs, output=str(tmp_path / "out"), launch=False, **OPTIONS)
    launch(plan)
    work = runs.generations.read_units(spark, plan.spec.output)
    written, _ = sinks._observed(plan.apply(work.where("wave = 0"), 0).withColumn("attempt", F.lit(1)), [0, 1, 2])
    text = plan_of(written)
    assert text.count("FileScan") == 1 and "CollectMetrics" in text and "Exchange" not in text
    assert "PartitionFilters: [isnotnull(wave" in text      # other waves and shards are not opened


def test_shards_run_on_their_own_and_together(spark, docs, tmp_path):
    clean = embed(spark, docs, output=str(tmp_path / "clean"), **OPTIONS)
    out, failures = str(tmp_path / "out"), []
    plans = [embed(spark, docs, output=out, launch=False, **OPTIONS) for _ in range(3)]
    launch(plans[1], ranks=[1])
    assert {r["rank"] for r in sinks.read_parts(spark, out).select("rank").distinct().collect()} == {1}
    assert sorted(os.listdir(f"{out}/completions")) == [".shard-1.done.crc", ".stats-1.json.crc", "shard-1.done", "stats-1.json"]

    def work(rank):
        try:
            launch(plans[rank], ranks=[rank])
        except Exception as error:   # shown by the assertion
            failures.append(error)

    both = [threading.Thread(target=work, args=(r,)) for r in (0, 2)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert failures == []
    run = launch(plans[0])
    assert run.status().complete() and texts(run) == texts(clean)
    assert run.status().stats.agg(F.sum("rows_done_prior"), F.sum("rows_processed")).head() == (15, 0)
    assert not [n for n in os.listdir(f"{out}/_claims") if "rank" in n or "alive" in n]
    with pytest.raises(SpecError):
        launch(plans[0], ranks=[3])


def test_launches_that_start_together_stage_the_units_once(spark, docs, tmp_path, monkeypatch):
    out, staged, failures = str(tmp_path / "out"), [], []
    real = runs.generations.stage_units
    monkeypatch.setattr(runs.generations, "stage_units", lambda *a: staged.append(1) or real(*a))
    plans = [embed(spark, docs, output=out, launch=False, **OPTIONS) for _ in range(3)]

    def work(rank):
        try:
            launch(plans[rank], ranks=[rank])
        except Exception as error:
            failures.append(error)

    threads = [threading.Thread(target=work, args=(r,)) for r in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert failures == [] and staged == [1]
    assert sinks.read_parts(spark, out).select("row_id").distinct().count() == 15 == sinks.read_parts(spark, out).count()


def test_a_claimed_shard_is_refused_until_its_launch_is_dead(spark, tmp_path):
    root = str(tmp_path)
    with claims.held(spark, root, ["rank-0", "rank-1"]):
        with pytest.raises(claims.ClaimedError), claims.held(spark, root, ["rank-2", "rank-1"]):
            pass
        with claims.held(spark, root, ["rank-2"]):
            pass
    # a launch that died: its claim is there, its sign of life grows old
    create_new(spark, f"{root}/_claims/rank-0-000000", '{"launch": "gone"}')
    with pytest.raises(claims.ClaimedError), claims.held(spark, root, ["rank-0"]):
        pass
    with claims.held(spark, root, ["rank-0"], take_over=True):
        assert [n for n in os.listdir(f"{root}/_claims") if n.startswith("rank")] == ["rank-0-000001"]
    create_new(spark, f"{root}/_claims/rank-0-000000", '{"launch": "gone"}')
    with claims.held(spark, root, ["rank-0"], lease=0.0001):
        pass


def test_only_one_creates_a_file(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda: won.append(create_new(spark, f"{tmp_path}/a b/c", "x"))) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 7 + [True]


def test_a_grown_source_goes_on(spark, docs, tmp_path):
    out = str(tmp_path / "out")
    embed(spark, docs, output=out, **OPTIONS)
    before = {r.row_id: r.attempt for r in sinks.read_parts(spark, out).collect()}
    more = spark.range(100, 110).select("id", F.concat(F.lit("new "), "id").alias("text"))
    more.write.mode("append").parquet(docs)
    run = embed(spark, docs, output=out, **OPTIONS)
    after = {r.row_id: r.attempt for r in sinks.read_parts(spark, out).collect()}
    assert {k: v for k, v in after.items() if k in before} == before and set(after) - set(before) == {"b-100", "b-104", "b-108"}
    p = run.status().progress.head()
    assert (p.rows_ok, p.expected_rows, p.pct) == (18, 18, 1.0) and run.status().complete()
    again = embed(spark, docs, output=out, **OPTIONS)
    assert again.status().stats.agg(F.sum("rows_processed")).head()[0] == 0
    spark.createDataFrame([(100, "again")], "id bigint, text string").write.mode("append").parquet(docs)
    with pytest.raises(DuplicateIdError):
        embed(spark, docs, output=out, **OPTIONS)


def test_a_changed_source_and_a_limit_are_refused(spark, docs, tmp_path):
    out = str(tmp_path / "out")
    embed(spark, docs, output=out, limit=10, **OPTIONS)
    extra = spark.createDataFrame([(900, "x")], "id bigint, text string")
    extra.write.mode("append").parquet(docs)
    with pytest.raises(SpecError, match="first 10 rows"):
        embed(spark, docs, output=out, limit=10, **OPTIONS)
    out = str(tmp_path / "out2")
    embed(spark, docs, output=out, **OPTIONS)
    os.remove(max((f"{docs}/{n}" for n in os.listdir(docs) if n.startswith("part")), key=os.path.getsize))
    with pytest.raises(SpecError, match="is gone"):
        embed(spark, docs, output=out, **OPTIONS)


def test_a_grown_generation_asks_for_new_contents_only(spark, tmp_path):
    path, out = str(tmp_path / "prompts"), str(tmp_path / "out")
    spark.range(30).select("id", F.concat(F.lit("p"), F.col("id") % 10).alias("prompt")).write.parquet(path)
    options = dict(model="echo", output=out, id_column="id", column="prompt", world=2)
    generate(spark, path, **options)
    spark.range(30, 60).select("id", F.concat(F.lit("p"), F.col("id") % 15).alias("prompt")).write.mode("append").parquet(path)
    run = generate(spark, path, **options)
    rows = sinks.read_parts(spark, out).collect()
    assert sorted(r.prompt for r in rows) == sorted(f"p{i}" for i in range(15)) and run.status().complete()


@pytest.mark.parametrize("errors", [False, True])
def test_healing_moves_no_payload(spark, docs, tmp_path, plan_of, errors):
    """Half of all rows failed once; with automatic broadcasts off there is no exchange of results."""
    out = str(tmp_path / "out")
    embed(spark, docs, output=out, factory=build("faulty", {"raise_on": "omega"}), **OPTIONS)
    embed(spark, docs, output=out, **OPTIONS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = sinks.read_healed(spark, out, errors)
        text = plan_of(read)
        assert "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text
        rows = read.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 15 == len({r.row_id for r in rows}) and all(r.error is None for r in rows)


def test_deletion_vectors_reach_every_position(spark, tmp_path, monkeypatch):
    """Losers in every bucket of large files, and more files than one pack of vectors takes."""
    monkeypatch.setattr(healing, "VECTOR_BYTES", 1)
    root, n = str(tmp_path), 70_000
    for attempt, bad in enumerate(("id % 3 = 0", "id % 2 = 0")):
        rows = spark.range(n).select(
            F.col("id").cast("string").alias("row_id"), F.lit(0).cast("bigint").alias("wave"), F.lit(0).alias("rank"),
            F.lit(attempt).cast("bigint").alias("attempt"), F.when(F.expr(bad), "e").alias("error")).coalesce(1 + attempt)
        sinks.commit(rows, root, sinks.part_name(attempt, 0))
    for errors in (False, True):
        got = sinks.read_healed(spark, root, errors).select("row_id", "attempt", "error")
        want = healing.healed(sinks.read_parts(spark, root), include_errors=errors).select("row_id", "attempt", "error")
        assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
        assert got.count() == (n if errors else n - len(range(0, n, 6)))
