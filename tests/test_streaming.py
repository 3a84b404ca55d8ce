"""Streams: new files are picked up, restarts repeat nothing, replays replace."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from inferlake import JobSpec, SpecError, embed, launch
from inferlake.sources import sinks
from inferlake.streaming import inference, progress
from inferlake.streaming.dedup import dedup_stream
from inferlake.streaming.watch import until_done


def add(spark, folder, start, n):
    (spark.range(start, start + n)
     .select("id", F.concat(F.lit("p"), F.col("id") % 40).alias("text"))
     .coalesce(1).write.mode("append").parquet(folder))


def stream(spark, folder):
    return spark.readStream.schema("id bigint, text string").parquet(folder)


def test_generation_continues_after_a_restart(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spec = JobSpec(task="generation", dataset="stream", model="echo", output=out)
    add(spark, folder, 0, 30)
    inference.start(stream(spark, folder), spec, check).awaitTermination()
    assert sinks.read_healed(spark, out).count() == 30
    add(spark, folder, 20, 60)
    inference.start(stream(spark, folder), spec, check).awaitTermination()
    rows = sinks.read_parts(spark, out).collect()
    assert len(rows) == 40 == len({r.row_id for r in rows})   # each content asked once
    assert all(r.response == "echo: " + r.text for r in rows)


def test_pages_arrive_as_a_stream(spark, tmp_path):
    scans, out = tmp_path / "scans", str(tmp_path / "out")
    scans.mkdir()
    spec = JobSpec(task="ocr", dataset=f"{scans}/*.png", model="tag-stripper", output=out)
    for i in range(2):
        (scans / f"{i}.png").write_text(f"<p>page {i}</p>")
        pages = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.png") \
            .schema("path string, modificationTime timestamp, length bigint, content binary") \
            .load(str(scans))
        inference.start(pages, spec, str(tmp_path / "check")).awaitTermination()
        rows = {r.row_id: r.markdown for r in sinks.read_healed(spark, out).collect()}
        assert rows == {f"{j}.png": f"page {j}" for j in range(i + 1)}


def test_replayed_batch_replaces_its_part(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spec = JobSpec(task="embeddings", dataset="stream", model="hash-embedder", output=out,
                   id_column="id", batch=8)
    add(spark, folder, 0, 30)
    inference.start(stream(spark, folder), spec, check).awaitTermination()
    before = {r.row_id for r in sinks.read_parts(spark, out).collect()}
    for name in os.listdir(f"{check}/commits"):               # died before the commit was noted
        if name.strip(".").startswith("0"):
            os.remove(f"{check}/commits/{name}")
    inference.start(stream(spark, folder), spec, check).awaitTermination()
    rows = sinks.read_parts(spark, out).collect()
    assert {r.row_id for r in rows} == before and len(rows) == 4
    assert sum(r.n_texts for r in rows) == 30


def test_bounded_state_needs_a_time_column(spark, tmp_path):
    folder = str(tmp_path / "in")
    (spark.range(10).select((F.col("id") % 2).cast("string").alias("text"),
                            F.timestamp_seconds("id").alias("ts")).write.parquet(folder))
    source = spark.readStream.schema("text string, ts timestamp").parquet(folder)
    out = str(tmp_path / "out")
    (dedup_stream(source, "text", "ts", "1 hour").writeStream.format("parquet")
     .option("path", out).option("checkpointLocation", str(tmp_path / "c"))
     .trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(out).count() == 2


def test_commits_can_be_followed(spark, tmp_path):
    folder, out, target, check = (str(tmp_path / n) for n in ("in", "out", "totals", "check"))
    spec = JobSpec(task="generation", dataset="stream", model="echo", output=out)

    def totals():
        progress.start(progress.committed(spark, out), target, check).awaitTermination()
        updates = spark.read.option("recursiveFileLookup", "true").parquet(target)
        return [tuple(r) for r in progress.latest(updates).select("run", "rows_ok").collect()]

    add(spark, folder, 0, 25)
    inference.start(stream(spark, folder), spec, str(tmp_path / "c")).awaitTermination()
    assert totals() == [("out", 25)]
    add(spark, folder, 20, 15)
    inference.start(stream(spark, folder), spec, str(tmp_path / "c")).awaitTermination()
    assert totals() == [("out", 35)]


def test_live_totals(spark, tmp_path):
    folder, target, check = (str(tmp_path / n) for n in ("in", "totals", "check"))
    schema = "run string, ok bigint"

    def add_ticks(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)

    def totals():
        progress.start(spark.readStream.schema(schema).parquet(folder), target,
                       check).awaitTermination()
        updates = spark.read.option("recursiveFileLookup", "true").parquet(target)
        return {r.run: (r.rows_ok, r.ticks) for r in progress.latest(updates).collect()}

    add_ticks(("a", 1), ("b", None))
    assert totals() == {"a": (1, 1), "b": (0, 1)}
    add_ticks(("a", 5))
    assert totals() == {"a": (6, 2), "b": (0, 1)}
    shutil.rmtree(folder)


def test_a_stream_is_a_full_run(spark, tmp_path):
    """Without ids, with equal rows, over a restart: record, log, ticks, stats and marker, each batch counted once."""
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spec = JobSpec(task="embeddings", dataset="stream", model="hash-embedder", output=out, batch=8)
    texts = spark.createDataFrame([("same",)] * 9 + [("",), (None,), ("other",)], "text string")
    for k in range(2):
        texts.coalesce(1).write.mode("append").parquet(folder)
        run = inference.start(spark.readStream.schema("text string").parquet(folder), spec, check)
        assert not os.path.exists(f"{out}/completions/shard-0.done") or k == 0
        run.awaitTermination()
        found = run.status()
        p = found.progress.head()
        assert (p.rows_ok, p.rows_failed, p.exact, p.has_run_json) == (2 * (k + 1), 0, True, True) and found.complete()
        assert sum(r.ok for r in found.telemetry.collect()) == 2 * (k + 1)
        assert sorted(t for r in run.results().collect() for t in r.texts) == sorted((["same"] * 9 + ["other"]) * (k + 1))
    for name in os.listdir(f"{check}/commits"):               # the last batch is replayed
        if name.strip(".").startswith("1"):
            os.remove(f"{check}/commits/{name}")
    run = inference.start(spark.readStream.schema("text string").parquet(folder), spec, check)
    run.awaitTermination()
    assert run.status().progress.head().rows_ok == 4 == run.results().count()
    assert sum(r.ok for r in run.status().ticks.collect()) == 4
    published = spark.read.parquet(run.publish(str(tmp_path / "clean")))
    assert published.columns == ["row_id", "member_ids", "texts", "embeddings", "n_texts", "prompt_tokens"]
    with pytest.raises(SpecError):
        inference.start(spark.readStream.schema("text string").parquet(folder),
                        JobSpec(task="embeddings", dataset="stream", model="hash-embedder", output=out, batch=9), check)


def test_late_copies_are_asked_again_and_read_once(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spec = JobSpec(task="generation", dataset="stream", model="echo", output=out)
    schema = "text string, at timestamp"
    for hour in (10, 11, 60, 61, 62):
        rows = spark.createDataFrame([("a", hour * 3600), (f"b{hour}", hour * 3600)], "text string, s bigint")
        rows.select("text", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(folder)
        run = inference.start(spark.readStream.schema(schema).parquet(folder), spec, check, time_column="at", delay="2 hours")
        run.awaitTermination()
    assert sorted(r.text for r in run.results().collect()) == ["a", "b10", "b11", "b60", "b61", "b62"]
    asked = [r.text for r in sinks.read_parts(spark, out).collect()]
    assert asked.count("a") == 2                     # forgotten once, when the stream's time was far ahead


def test_a_page_stream_takes_prompt_and_top_p(spark, tmp_path):
    scans, out = tmp_path / "scans", str(tmp_path / "out")
    scans.mkdir()
    (scans / "0.png").write_text("<p>page</p>")
    spec = JobSpec(task="ocr", dataset=f"{scans}/*.png", model="any", output=out,
                   settings={"prompt": "Read this.", "top_p": 0.5})

    class Asked:
        def predict(self, requests):
            return [{"choices": [{"message": {"content": f"{r['top_p']} {r['messages'][0]['content'][0]['text']}"}}]} for r in requests]

    pages = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary").load(str(scans))
    inference.start(pages, spec, str(tmp_path / "check"), model=Asked).awaitTermination()
    assert [r.markdown for r in sinks.read_healed(spark, out).collect()] == ["0.5 Read this."]


def test_progress_ends_when_all_shards_are_done(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(40).select("id", F.concat(F.lit("t"), "id").alias("text")).write.parquet(path)
    options = dict(id_column="id", column="text", batch=4, world=2, wave_units=3, launch=False)
    plans = [embed(spark, path, output=str(tmp_path / name), **options) for name in ("a", "b")]
    for plan in plans:
        launch(plan, ranks=[0])
    watch = until_done(spark, [p.spec.output for p in plans], str(tmp_path / "check"), silence=2)
    for _ in range(30):
        assert not watch.wait(4) and watch.query.isActive and not watch.final
        if any(c["stalled"] for c in watch.changes):
            break
    assert any(c["stalled"] for c in watch.changes)
    for plan in plans:
        launch(plan, ranks=[1])
    assert watch.wait(300) and not watch.query.isActive
    assert {k: (f["rows_ok"], f["rows_failed"], f["shards_done"], f["world"]) for k, f in watch.final.items()} == {
        "a": (10, 0, 2, 2), "b": (10, 0, 2, 2)}
    assert sum(1 for c in watch.changes if c["final"]) == 2
