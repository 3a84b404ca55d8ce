"""Progress rebuilt from an output folder alone."""

import json

import pytest

from inferlake import status

# Shard 1 of three has ended; shard 2 is under way; shard 0 has left nothing.
ENDED = {"rank": 1, "world": 3, "rows_total": 31, "rows_done_prior": 5, "rows_processed": 26,
         "rows_failed": 3, "rows_deduped": 2, "prompt_tokens": 7300, "completion_tokens": 11,
         "elapsed_s": 12.5, "tokens_per_sec": 584.9, "hints": ["slow start"]}
OKS = {"1-40": [3, 4], "1-70": [6, 5, 8], "2-55": [9]}   # shard-epoch: good rows of each tick


def lines(oks, **extra):
    return "".join(json.dumps({"ok": ok, "t": 5 * n, **extra}) + "\n" for n, ok in enumerate(oks))


def build(root, stats=True, record=True):
    for folder in ("completions", "_manifest"):
        (root / folder).mkdir(parents=True)
    for part, listed in (("part-7-0.parquet", True), ("part-7-1.parquet", False), ("part-9-1.parquet", True)):
        (root / part).write_bytes(b"p")
        if listed:
            (root / "_manifest" / f"ids-{part}").write_bytes(b"i")
    if stats:
        (root / "completions/stats-1.json").write_text(json.dumps(ENDED))
    (root / "completions/shard-1.done").touch()
    for name, oks in OKS.items():
        (root / f"telemetry-shard{name}.jsonl").write_text(lines(oks) + " \t \n")
    if record:
        (root / "run.json").write_text(json.dumps({
            "task": "generation", "run_id": "7e11", "world": 3, "expected_rows": 124, "items_per_row": 4,
            "expected_items": 496, "spec": {"column": "q"}, "created_at": "2025-01-02T03:04:05+00:00"}))
    return str(root)


def test_exact(spark, tmp_path):
    s = status(spark, build(tmp_path / "a run"))
    p = s.progress.head()
    assert (p.run, p.exact, p.rows_ok, p.rows_failed, p.expected_rows, p.pct, p.items_ok) == (
        "a run", True, 31, 3, 124, 0.25, 124)
    assert s.storage.head()[1:] == (3, 1, 3, False)
    shards = {r["rank"]: r for r in s.shards.collect()}
    assert [shards[k].done for k in range(3)] == [False, True, False]
    assert shards[1].stats.rows_deduped == 2 and shards[2].stats is None
    window = s.telemetry.where("rank = 1").orderBy("line").collect()
    assert [(t.t, t.ok) for t in window] == [(0, 6), (5, 5), (10, 8)]
    assert not s.complete()
    doc = json.loads(s.document.head().document)
    assert doc["run_id"] == "7e11" and doc["spec"] == {"column": "q"}
    assert doc["storage"] == {"parts": 3, "orphans": 1, "world": 3, "world_inferred": False}
    assert [t["ok"] for t in doc["telemetry"]["2"]] == [9]


def test_approximate_without_stats(spark, tmp_path):
    s = status(spark, build(tmp_path / "run", stats=False))
    p = s.progress.head()
    assert (p.exact, p.rows_ok, p.rows_failed) == (False, 35, None)
    assert s.world.head()[1:] == (3, False)


def test_world_inferred_without_record(spark, tmp_path):
    s = status(spark, build(tmp_path / "run", stats=False, record=False))
    assert s.world.head()[1:] == (3, True)
    p = s.progress.head()
    assert p.expected_rows is None and p.pct is None and not p.has_run_json


def test_odd_fields_take_no_others_with_them(spark, tmp_path):
    root = tmp_path / "run"
    out = build(root)
    (root / "completions/stats-1.json").write_text(json.dumps({**ENDED, "final_limit": 4.5, "hints": "none"}))
    record = json.loads((root / "run.json").read_text())
    (root / "run.json").write_text(json.dumps({**record, "created_at": "yesterday", "version": [2]}))
    (root / "telemetry-shard2-55.jsonl").write_text(lines([9], waiting="many", limit=1.5))
    s = status(spark, out)
    p = s.progress.head()
    assert (p.exact, p.rows_ok, p.expected_rows, p.has_run_json) == (True, 31, 124, True)
    assert s.telemetry.where("rank = 2").head().ok == 9


def test_missing_output(spark, tmp_path):
    s = status(spark, str(tmp_path / "nothing"))
    assert s.storage.head()[1:] == (0, 0, None, False)
    assert s.progress.head().rows_ok == 0 and not s.complete()


def test_unreadable_files_are_left_out(spark, tmp_path):
    root = tmp_path / "run"
    out = build(root)
    (root / "completions/stats-2.json").write_text("[1, 2")
    with open(root / "telemetry-shard1-70.jsonl", "a") as f:
        f.write("no json\n")
    s = status(spark, out)
    assert s.progress.head().rows_ok == 31
    assert s.telemetry.where("rank = 1").count() == 0      # the newest file is bad: no window at all
    assert s.telemetry.where("rank = 2").count() == 1
    assert s.ticks.where("rank = 1").count() == 2          # the older file still counts


def test_tick_window_is_the_tail(spark, tmp_path):
    out = build(tmp_path / "run", stats=False)
    (tmp_path / "run/telemetry-shard0-300.jsonl").write_text(
        "\n".join(json.dumps({"t": t, "ok": 1}) for t in range(500)))
    rows = status(spark, out).telemetry.where("rank = 0").orderBy("line").collect()
    assert [r.t for r in rows] == list(range(380, 500))


def test_record_without_world_is_not_inferred(spark, tmp_path):
    out = build(tmp_path / "run", stats=False)
    (tmp_path / "run/run.json").write_text('{"version": 1, "expected_rows": 0}')
    s = status(spark, out)
    assert s.world.head()[1:] == (None, False)
    assert s.progress.head().pct is None


def test_many_runs_at_once(spark, tmp_path):
    build(tmp_path / "runs/a")
    build(tmp_path / "runs/b", stats=False)
    s = status(spark, f"{tmp_path}/runs/*")
    assert {r.run: r.rows_ok for r in s.progress.collect()} == {"a": 31, "b": 35}
    assert {r.run: (r.parts, r.orphans) for r in s.storage.collect()} == {"a": (3, 1), "b": (3, 1)}


@pytest.mark.parametrize("name", ["part-00000-0a1b-c000.snappy.parquet", "part-1-2.parquet"])
def test_part_names_carry_no_meaning(spark, tmp_path, name):
    out = build(tmp_path / "run")
    (tmp_path / "run" / name).write_bytes(b"x")
    assert status(spark, out).storage.head().parts == 4
