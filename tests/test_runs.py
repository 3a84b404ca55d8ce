"""Runs: resume, errors, healing, publishing."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from inferlake import SpecError, embed, generate, launch, status
from inferlake.models import HashEmbedder, build
from inferlake.operators.healing import healed
from inferlake.plans.runs import NotFinishedError, publish
from inferlake.sources import sinks

TEXTS = [f"text number {i} {'omega' if i % 10 == 3 else 'alpha'}" for i in range(95)] + ["", "  ", None]


@pytest.fixture
def docs(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string").repartition(3) \
        .write.parquet(path)
    return path


def plain(df):
    return sorted((r.row_id, tuple(r.texts), r.n_texts, r.prompt_tokens,
                   tuple(map(tuple, r.embeddings))) for r in df.collect())


def run(spark, docs, out, **over):
    options = dict(id_column="id", batch=4, world=3, wave_units=6)
    return embed(spark, docs, output=out, **{**options, **over})


def test_run_leaves_the_contract_files(spark, docs, tmp_path):
    out = str(tmp_path / "out")
    done = run(spark, docs, out)
    parts = sorted(os.path.basename(p) for p in glob.glob(f"{out}/part-*.parquet"))
    sidecars = sorted(os.path.basename(p) for p in glob.glob(f"{out}/_manifest/ids-*"))
    assert len(parts) == 4 and sidecars == [f"ids-{p}" for p in parts]
    assert sorted(os.listdir(f"{out}/completions")) and os.path.exists(f"{out}/run.json")
    s = done.status()
    assert s.complete()
    p = s.progress.head()
    assert (p.rows_ok, p.rows_failed, p.expected_rows, p.items_per_row) == (24, 0, 25, 4)
    assert s.storage.head()[1:] == (4, 0, 3, False)
    assert {r["rank"]: r.stats.rows_total for r in s.shards.collect()} == {0: 8, 1: 8, 2: 8}
    record = s.records.head()
    assert record.run_id == done.run_id and '"column":"detected"' in record.resolved


def test_progress_shows_before_the_end(spark, docs, tmp_path):
    out = str(tmp_path / "out")
    run(spark, docs, out)
    shutil.rmtree(f"{out}/completions")                   # as if it were still on
    s = status(spark, out)
    p = s.progress.head()
    assert (p.exact, p.rows_ok, p.rows_failed) == (False, 24, None)
    assert {(r["rank"], r.ok) for r in s.telemetry.collect()} == {(0, 2), (1, 2), (2, 2)}
    assert s.telemetry.count() == 12 and not s.complete()


def test_interrupted_run_equals_a_clean_one(spark, docs, tmp_path):
    clean = plain(run(spark, docs, str(tmp_path / "clean")).results())
    out = str(tmp_path / "out")
    run(spark, docs, out)
    lost = sorted(glob.glob(f"{out}/part-*.parquet"))
    for part in lost[1:3]:                                # two commits never happened
        shutil.rmtree(part)
        shutil.rmtree(f"{out}/_manifest/ids-{os.path.basename(part)}")
    again = run(spark, docs, out)
    assert plain(again.results()) == clean
    stats = again.status().stats.agg(F.sum("rows_done_prior"), F.sum("rows_processed")).head()
    assert tuple(stats) == (12, 12)


def test_orphan_parts_are_adopted(spark, docs, tmp_path):
    out = str(tmp_path / "out")
    run(spark, docs, out)
    part = os.path.basename(sorted(glob.glob(f"{out}/part-*.parquet"))[0])
    shutil.rmtree(f"{out}/_manifest/ids-{part}")
    assert status(spark, out).storage.head().orphans == 1
    again = run(spark, docs, out)
    assert again.status().stats.agg(F.sum("rows_processed")).head()[0] == 0
    assert again.status().storage.head().orphans == 0


@pytest.mark.parametrize("change", [{"batch": 5}, {"limit": 10}, {"world": 2}, {"wave_units": 7}])
def test_resume_with_other_settings_is_refused(spark, docs, tmp_path, change):
    out = str(tmp_path / "out")
    run(spark, docs, out)
    with pytest.raises(SpecError):
        run(spark, docs, out, **change)


def test_errors_are_rows_and_a_later_run_heals_them(spark, docs, tmp_path):
    out = str(tmp_path / "out")
    bad = run(spark, docs, out, factory=build("faulty", {"raise_on": "omega"}))
    errors = bad.results(include_errors=True).where("error IS NOT NULL")
    failed = errors.count()
    assert 0 < failed < 24 and bad.results().count() == 24 - failed
    assert {r.error for r in errors.collect()} == {"RuntimeError: model refused the request"}
    p = bad.status().progress.head()
    assert (p.rows_ok, p.rows_failed) == (24, failed)     # failures stay in the count
    good = run(spark, docs, out)
    assert plain(good.results()) == plain(run(spark, docs, str(tmp_path / "clean")).results())
    stats = good.status().stats.agg(F.sum("rows_done_prior"), F.sum("rows_processed")).head()
    assert tuple(stats) == (24 - failed, failed)


def test_short_answers_never_count_as_success(spark, docs, tmp_path):
    out = str(tmp_path / "out")
    rows = run(spark, docs, out, factory=build("faulty", {"short_on": "omega"})) \
        .results(include_errors=True).where("error IS NOT NULL").collect()
    assert {(len(r.texts), r.error) for r in rows} == {
        (4, "3 vectors for 4 texts"), (3, "2 vectors for 3 texts")}
    assert all(r.embeddings is None and r.n_texts is None for r in rows)


def test_embedding_without_ids_keeps_every_row(spark, tmp_path):
    texts = ["same "] * 30 + [f"t{i}" for i in range(20)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    done = embed(spark, df, output=str(tmp_path / "out"), batch=8)
    rows = done.results().collect()
    assert sorted(t for r in rows for t in r.texts) == sorted(["same"] * 30 + [f"t{i}" for i in range(20)])
    assert done.status().complete() and sorted(r.n_texts for r in rows) == [2, *[8] * 6]


def test_files_without_ids_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "source")
    texts = [f"t{i}" for i in range(30)] + ["t3"] * 5
    spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(path)
    first = embed(spark, path, output=str(tmp_path / "few"), batch=4, limit=7)
    rows = sorted(first.results().collect(), key=lambda r: r.member_ids)
    assert [t for r in rows for t in r.texts] == texts[:7]
    answers = generate(spark, path, model="echo", column="text", output=str(tmp_path / "gen"), limit=33)
    assert {r.text: r.n_copies for r in answers.results().collect()} == {**dict.fromkeys(texts[:30], 1), "t3": 4}


def test_resume_refuses_another_model_or_source(spark, tmp_path):
    path, out = str(tmp_path / "source"), str(tmp_path / "out")
    spark.range(8).select(F.concat(F.lit("t"), "id").alias("text")).write.parquet(path)
    embed(spark, path, output=out, batch=4)
    with pytest.raises(SpecError, match="settings"):
        embed(spark, path, output=out, batch=4, settings={"model": {"dims": 2}})
    spark.range(8, 16).select(F.concat(F.lit("t"), "id").alias("text")).write.mode("overwrite").parquet(path)
    with pytest.raises(SpecError, match="source: .* is gone"):
        embed(spark, path, output=out, batch=4)
    rows = [spark.createDataFrame([(f"{k}{i}",) for i in range(5)], "text string") for k in "ab"]
    embed(spark, rows[0], output=str(tmp_path / "rows"))
    with pytest.raises(SpecError, match="source"):
        embed(spark, rows[1], output=str(tmp_path / "rows"))


def test_limit_counts_input_rows(spark, docs, tmp_path):
    done = run(spark, docs, str(tmp_path / "out"), limit=97)
    assert done.results().agg(F.sum("n_texts")).head()[0] == 95      # two of them are empty
    assert done.status().progress.head().expected_rows == 25


def test_launch_leaves_no_staged_tables(spark, docs, tmp_path):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(base))
    run(spark, docs, str(tmp_path / "out"))
    assert set(os.listdir(base)) == before


def test_plan_without_launch_writes_nothing(spark, docs, tmp_path):
    out = str(tmp_path / "out")
    plan = run(spark, docs, out, launch=False)
    assert not os.path.exists(out) and plan.record["items_per_row"] == 4
    assert plan.record["expected_rows"] == 25
    assert launch(plan).output == out


def test_publish_waits_for_all_shards(spark, docs, tmp_path):
    out = str(tmp_path / "out")
    done = run(spark, docs, out)
    target = done.publish(str(tmp_path / "clean"))
    table = spark.read.parquet(target)
    assert table.columns == ["row_id", "member_ids", "texts", "embeddings", "n_texts",
                             "prompt_tokens"]
    assert table.count() == 24
    os.remove(f"{out}/completions/shard-1.done")
    with pytest.raises(NotFinishedError):
        publish(spark, out, str(tmp_path / "never"))


def test_generation_asks_once_per_content(spark, tmp_path):
    prompts = ["same"] * 40 + [f"p{i}" for i in range(20)] + [None, None, "", ""]
    df = spark.createDataFrame(list(enumerate(prompts)), "id bigint, prompt string")
    out = str(tmp_path / "gen")
    done = generate(spark, df, model="echo", output=out, id_column="id", column="prompt", world=2)
    rows = {r.prompt: r for r in done.results().collect()}
    assert len(rows) == 23 and rows["same"].n_copies == 40
    assert rows["same"].response == "echo: same" and rows[None].row_id != rows[""].row_id
    assert {r["rank"] for r in done.results().where("prompt <> 'same'").collect()} == {0, 1}
    assert done.status().stats.agg(F.sum("rows_deduped")).head()[0] == 41
    # without an id column each content is still asked for once
    out = str(tmp_path / "gen2")
    again = generate(spark, df, model="echo", output=out, column="prompt", wave_units=5)
    assert {r.row_id for r in again.results().collect()} == {r.row_id for r in rows.values()}


def test_generation_waves_resume(spark, tmp_path):
    df = spark.range(50).select("id", F.concat(F.lit("p"), F.col("id") % 30).alias("prompt"))
    out = str(tmp_path / "gen")
    options = dict(model="echo", output=out, id_column="id", column="prompt", wave_units=10)
    first = generate(spark, df, **options)
    assert first.results().count() == 30
    assert generate(spark, df, **options).status().stats.head().rows_processed == 0


def test_parts_honour_rows_per_file(spark, docs, tmp_path):
    out = str(tmp_path / "out")
    run(spark, docs, out, rows_per_file=2, wave_units=100)
    part = glob.glob(f"{out}/part-*.parquet")[0]
    for name in glob.glob(f"{part}/*.parquet"):
        assert spark.read.parquet(name).count() <= 2


def test_two_views_do_not_mix(spark, docs, tmp_path):
    out = str(tmp_path / "out")
    run(spark, docs, out)
    data, manifest = sinks.create_views(spark, out, "v")
    assert spark.table(data).count() == spark.table(manifest).count() == 24
    assert "embeddings" in spark.table(data).columns
    assert "embeddings" not in spark.table(manifest).columns


def test_healing_prefers_good_then_latest(spark, plan_of):
    rows = [("a", 1, "e"), ("a", 2, None), ("a", 3, "e"), ("b", 1, "x"), ("b", 2, "y"),
            ("c", 1, None), ("c", 2, None)]
    df = spark.createDataFrame(rows, "row_id string, attempt bigint, error string")
    best = healed(df, include_errors=True)
    got = {r.row_id: (r.attempt, r.error) for r in best.collect()}
    assert got == {"a": (2, None), "b": (2, "y"), "c": (2, None)}
    assert {r.row_id for r in healed(df).collect()} == {"a", "c"}
    assert "WindowGroupLimit" in plan_of(best)


def test_healed_files_agree_with_the_window(spark, tmp_path):
    root = str(tmp_path / "out")
    for attempt, rows in enumerate([[("a", None), ("b", "e"), ("c", "e")], [("b", None)],
                                    [("a", None), ("a", "e"), ("c", "f"), ("a", None)]]):
        df = spark.createDataFrame([(r, e, attempt) for r, e in rows],
                                   "row_id string, error string, attempt bigint")
        sinks.commit(df, root, sinks.part_name(attempt, 0))
    for errors in (False, True):
        want = healed(sinks.read_parts(spark, root), include_errors=errors)
        got = sinks.read_healed(spark, root, errors)
        columns = ["row_id", "attempt", "error"]
        assert sorted(map(str, got.select(columns).collect())) == \
            sorted(map(str, want.select(columns).collect()))


def test_hash_embedder_is_deterministic():
    body = HashEmbedder().predict([{"input": ["a b  a", ""]}])[0]
    assert sum(body["data"][0]["embedding"]) == 3 and body["usage"]["prompt_tokens"] == 3
