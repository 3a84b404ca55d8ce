"""Status from commit logs in place of listings, and logs that are folded when a launch ends."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from inferlake import embed, status
from inferlake.operators import progress as prog
from inferlake.plans import runs
from inferlake.sources import outputs, sinks

FIELDS = ["run", "kind", "part", "rank", "epoch"]


def make_run(spark, output, n=200, **options):
    docs = spark.range(n).select("id", F.concat(F.lit("text "), "id").alias("text"))
    return embed(spark, docs, id_column="id", output=output, batch=8, wave_units=5, world=2, **options)


def facts(files):
    wanted = files.where("kind in ('part', 'manifest', 'marker', 'telemetry', 'run_record')")
    return sorted((tuple(r) for r in wanted.select(*FIELDS).distinct().collect()), key=str)


@pytest.fixture(scope="module")
def parent(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    for name in ("first", "second run"):
        make_run(spark, f"{folder}/{name}")
    old = folder / "other"                        # an output of another writer
    (old / "completions").mkdir(parents=True)
    (old / "completions/shard-0.done").touch()
    (old / "part-1-0.parquet").write_text("x")
    (old / "run.json").write_text(json.dumps({"world": 1, "expected_rows": 3}))
    return str(folder)


def test_the_log_says_what_a_listing_says(spark, parent):
    for output in (f"{parent}/first", f"{parent}/second run", f"{parent}/other", f"{parent}/*"):
        assert facts(outputs.list_outputs(spark, output)) == facts(outputs.list_outputs(spark, output, audit=True))


def test_part_folders_are_not_listed(spark, parent):
    files = outputs.list_outputs(spark, f"{parent}/first")
    assert files.where("kind = 'part'").count() == len(glob.glob(f"{parent}/first/part-*"))
    assert not any(path.split("/first/")[1].startswith("part-") for path in files.inputFiles())


def test_status_is_the_same(spark, parent):
    a, b = status(spark, f"{parent}/*"), status(spark, f"{parent}/*", audit=True)
    for table in ("progress", "storage", "shards", "world"):
        got, want = (sorted(map(str, getattr(s, table).collect())) for s in (a, b))
        assert got == want and got


def test_roster_in_one_plan(spark, parent):
    s = status(spark, f"{parent}/*")
    old = prog.shard_roster(s.files, s.stats, s.world)
    assert sorted(map(str, old.collect())) == sorted(map(str, s.shards.collect()))


def test_roster_adds_shards_that_left_nothing(spark):
    files = spark.createDataFrame([("a", "x", "marker", None, 2, None), ("c", "x", "telemetry", None, 0, 1)],
                                  outputs.LISTING_SCHEMA)
    stats = spark.createDataFrame([], f"run string, rank int, {outputs.STATS_SCHEMA}")
    records = spark.createDataFrame([("a", 5), ("b", 2), ("d", None)], "run string, world int")
    got = sorted((r.run, r["rank"], r.done) for r in prog.known_shards(files, stats, records).collect())
    old = sorted((r.run, r["rank"], r.done) for r in prog.shard_roster(
        files, stats, prog.world_size(files, stats, records)).collect())
    assert got == old
    assert got == [("a", k, k == 2) for k in range(5)] + [("b", 0, False), ("b", 1, False), ("c", 0, False)]


def test_folded_entries_are_not_opened(spark, tmp_path):
    out = str(tmp_path / "run")
    make_run(spark, out)
    want = facts(outputs.list_outputs(spark, out))
    for entry in glob.glob(f"{out}/_log/*.json"):       # nobody reads them any more
        with open(entry, "w") as f:
            f.write('{"part": "part-0-wrong.parquet"}')
        crc = f"{os.path.dirname(entry)}/.{os.path.basename(entry)}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    assert facts(outputs.list_outputs(spark, out)) == want
    assert sinks.log_counts(spark, out).agg(F.sum("units")).head()[0] == 25


def test_a_part_that_a_crash_left_is_an_orphan(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "run")
    real, calls = sinks.write_manifest, []

    def crash(*args):
        calls.append(args)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(sinks, "write_manifest", crash)
    with pytest.raises(RuntimeError):
        make_run(spark, out)
    monkeypatch.undo()
    row = status(spark, out).storage.head()
    assert (row.parts, row.orphans) == (3, 1)
    assert facts(outputs.list_outputs(spark, out)) == facts(outputs.list_outputs(spark, out, audit=True))
    plan = make_run(spark, out, launch=False)
    runs.launch(plan, take_over=True)
    done = status(spark, out)
    assert done.complete() and done.storage.head().orphans == 0
    assert facts(done.files) == facts(outputs.list_outputs(spark, out, audit=True))


def test_a_part_that_was_never_written(spark, tmp_path):
    out = str(tmp_path / "run")
    make_run(spark, out)
    (tmp_path / "run/_begun/part-9-00000.parquet").write_text("begun")
    row = status(spark, out).storage.head()
    assert row.orphans == 0 and row.parts == len(glob.glob(f"{out}/part-*"))


def test_launches_of_the_same_moment_have_numbers_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks.time, "time_ns", lambda: 5_000_000_000)
    assert [sinks.new_attempt(spark, str(tmp_path)) for _ in range(3)] == [5000, 5001, 5002]
