import glob
import os
import re
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from inferlake import SpecError, ocr
from inferlake.functions.sizing import resize_plan
from inferlake.plans import generations, queries_rows, runs
from inferlake.sources import pages as page_source
from inferlake.sources import sinks
from inferlake.sources.pages import glob_regex, list_pages, read_group, split_glob

NAMES = ["a.png", "b.jpg", "x/c.png", "x/y/d[1].png", "x/y/e f.png", "x/z.txt"]


@pytest.fixture
def scans(tmp_path):
    root = tmp_path / "scans"
    for i, name in enumerate(NAMES):
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(f"<p>page {i}</p>")
    return str(root)


@pytest.mark.parametrize("glob,hits", [
    ("*.png", {"a.png"}), ("**/*.png", {"a.png", "x/c.png", "x/y/d[1].png", "x/y/e f.png"}),
    ("x/*.png", {"x/c.png"}), ("**/?.{png,jpg}", {"a.png", "b.jpg", "x/c.png"}),
    ("x/**", {"x/c.png", "x/y/d[1].png", "x/y/e f.png", "x/z.txt"}), ("[ab].*", {"a.png", "b.jpg"})])
def test_globs(glob, hits):
    assert {n for n in NAMES if re.search(glob_regex(glob), n)} == hits


def test_split_glob():
    assert split_glob("/a/b/**/*.png") == ("/a/b", "**/*.png")
    assert split_glob("s3://k/a*/b.png") == ("s3://k", "a*/b.png")


def test_listing_opens_no_file(spark, scans, plan_of):
    pages = list_pages(spark, f"{scans}/**/*.png")
    assert {r.row_id for r in pages.collect()} == {n for n in NAMES if n.endswith(".png")}
    assert "content" not in plan_of(pages)
    with pytest.raises(ValueError):
        list_pages(spark, f"{scans}/*.pdf")


def leaf_metric(df, name):
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves().iterator()
    found = []
    while leaves.hasNext():
        metric = leaves.next().metrics().get(name)
        if metric.isDefined():
            found.append(metric.get().value())
    return sum(found)


def test_a_group_opens_its_own_files_only(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.txt").write_text(f"<p>{i}</p>")
    seen, opened = [], 0
    for group in range(4):
        pages = read_group(spark, f"{tmp_path}/*.txt", 4, group)
        names = [r.path for r in pages.collect()]
        seen += names
        assert leaf_metric(pages, "numFiles") == len(names) < 40     # the others are pruned in the listing
        opened += len(names)
    assert opened == 40 == len(set(seen))


def test_pages_run_resumes_per_page(spark, scans, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    read = []
    real = runs.pages.read_group
    monkeypatch.setattr(runs.pages, "read_group", lambda *a: read.append(a[3]) or real(*a))
    options = dict(model="tag-stripper", output=out, world=2, wave_units=2)
    done = ocr(spark, f"{scans}/**/*.png", **options)
    got = {r.row_id: r for r in done.results().collect()}
    assert {k: v.markdown for k, v in got.items()} == {
        n: f"page {i}" for i, n in enumerate(NAMES) if n.endswith(".png")}
    assert all(r.model == "tag-stripper" for r in got.values())
    assert done.status().progress.head().expected_rows is None
    opened = len(read)
    ocr(spark, f"{scans}/**/*.png", **options)
    assert len(read) == opened <= 2                        # nothing is opened twice
    (os.makedirs(f"{scans}/new"), open(f"{scans}/new/n.png", "w").write("<p>new</p>"))
    grown = ocr(spark, f"{scans}/**/*.png", **options)
    assert {r.row_id: r.markdown for r in grown.results().collect()} == {
        **{k: v.markdown for k, v in got.items()}, "new/n.png": "new"}
    with pytest.raises(SpecError):
        ocr(spark, "org/dataset", model="tag-stripper", output=out)


def test_a_grown_page_run_reads_every_new_page(spark, tmp_path):
    """Pages of a later generation are found in their group, whatever number its first wave has."""
    root, out = tmp_path / "scans", str(tmp_path / "out")
    root.mkdir()
    for n in range(30):
        (root / f"{n}.txt").write_text(f"<p>{n}</p>")
    groups = list_pages(spark, f"{root}/*.txt", "_metadata.file_path").selectExpr("row_id", "pmod(xxhash64(file_path), 3) g")
    first = [r.row_id for r in groups.where("g < 2").limit(3).collect()]
    for n in range(30):
        if f"{n}.txt" not in first:
            (root / f"{n}.txt").unlink()
    options = dict(model="tag-stripper", output=out, wave_units=1)
    ocr(spark, f"{root}/*.txt", **options)
    for n in range(30, 36):
        (root / f"{n}.txt").write_text(f"<p>{n}</p>")
    grown = ocr(spark, f"{root}/*.txt", **options)
    assert {r.row_id for r in grown.results().collect()} == {*first, *(f"{n}.txt" for n in range(30, 36))}
    # the waves of the new pages are those that the hash of their paths names
    units = generations.read_units(spark, out).join(
        list_pages(spark, f"{root}/*.txt", "_metadata.file_path").select("row_id", "file_path"), "row_id")
    assert units.where("pmod(xxhash64(file_path), 3) <> pmod(wave, 3)").isEmpty()


def test_a_page_wave_lists_its_own_files(spark, scans, tmp_path, monkeypatch):
    listed = []
    real = page_source._load
    monkeypatch.setattr(page_source, "_load", lambda s, paths: listed.append(paths) or real(s, paths))
    done = ocr(spark, f"{scans}/**/*.png", model="tag-stripper", output=str(tmp_path / "out"), wave_units=1)
    waves = [p for p in listed if isinstance(p, list)]
    assert done.results().count() == sum(map(len, waves)) == 4
    assert len(listed) - len(waves) <= 3                   # the folder, whatever the number of waves


def test_small_page_waves_run_side_by_side(spark, tmp_path, monkeypatch):
    (tmp_path / "scans").mkdir()
    for n in range(12):
        (tmp_path / f"scans/{n}.txt").write_text(f"<p>{n}</p>")
    met, real = threading.Barrier(2), sinks.commit
    first = iter([True, True])      # two commits wait for each other

    def commit(*args):
        if next(first, False):
            met.wait(60)
        return real(*args)

    monkeypatch.setattr(sinks, "commit", commit)
    out = str(tmp_path / "out")
    done = ocr(spark, f"{tmp_path}/scans/*.txt", model="tag-stripper", output=out, world=2, wave_units=3)
    monkeypatch.undo()
    assert {r.row_id: r.markdown for r in done.results().collect()} == {f"{n}.txt": str(n) for n in range(12)}
    status = done.status()
    assert status.complete() and status.storage.head().orphans == 0
    stats = status.shards.select("stats.*").collect()
    assert sum(r.rows_processed for r in stats) == 12 == sum(r.rows_total for r in stats)
    assert status.telemetry.agg(F.sum("ok")).head()[0] == 12
    assert len(glob.glob(f"{out}/_manifest/ids-*/part-*")) == len(glob.glob(f"{out}/part-*"))     # a task for each sidecar


def test_a_failed_wave_lets_the_others_end(spark, tmp_path, monkeypatch):
    (tmp_path / "scans").mkdir()
    for n in range(12):
        (tmp_path / f"scans/{n}.txt").write_text(f"<p>{n}</p>")
    real, calls, ended = sinks.commit, iter(range(100)), []

    def commit(*args):
        if next(calls) == 0:
            raise RuntimeError("lost")
        result = real(*args)
        ended.append(args[2])
        return result

    monkeypatch.setattr(sinks, "commit", commit)
    options = dict(model="tag-stripper", output=str(tmp_path / "out"), wave_units=3)
    with pytest.raises(RuntimeError):
        ocr(spark, f"{tmp_path}/scans/*.txt", **options)
    assert set(sinks.committed_parts(spark, options["output"])) == set(ended)      # none is under way any more
    monkeypatch.undo()
    done = ocr(spark, f"{tmp_path}/scans/*.txt", **options)
    assert done.status().complete() and done.results().count() == 12
    assert set(ended) <= set(sinks.committed_parts(spark, options["output"]))


def test_a_launch_lists_the_page_folder_once(spark, scans, tmp_path, monkeypatch):
    listed = []
    real = page_source._load
    monkeypatch.setattr(page_source, "_load", lambda s, paths: listed.append(paths) or real(s, paths))
    ocr(spark, f"{scans}/**/*.png", model="tag-stripper", output=str(tmp_path / "out"), wave_units=1)
    assert len([p for p in listed if isinstance(p, str)]) == 1


def test_waves_share_the_cores(spark, tmp_path):
    paths = [str(tmp_path / f"{n} [{n}].txt") for n in range(1_300)]
    for n, path in enumerate(paths):
        with open(path, "w") as page:
            page.write(f"<p>{n}</p>")
    cores = spark.sparkContext.defaultParallelism
    for at_once, tasks in ((1, 2 * cores), (4, cores // 2), (100, 3)):
        read = read_group(spark, f"{tmp_path}/*.txt", 1, 0, paths, at_once)
        assert read.count() == 1_300 and read.select(F.spark_partition_id()).distinct().count() == tasks


def test_listings_side_by_side_put_the_setting_back(spark, tmp_path):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    paths = []
    for n in range(40):
        (tmp_path / f"{n}.txt").write_text("a")
        paths.append(str(tmp_path / f"{n}.txt"))
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda _: page_source._load(spark, paths).count(), range(12)))
    assert counts == [40] * 12 and spark.conf.get(key) == before


def test_folders_are_listed_in_a_few_tasks(spark, tmp_path, monkeypatch):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, seen = spark.conf.get(key), []
    real = type(spark.read).load
    monkeypatch.setattr(type(spark.read), "load", lambda *a, **k: seen.append(int(spark.conf.get(key))) or real(*a, **k))
    (tmp_path / "a.txt").write_text("a")
    assert list_pages(spark, f"{tmp_path}/*.txt").count() == 1
    assert seen == [4 * spark.sparkContext.defaultParallelism] and spark.conf.get(key) == before


def test_a_listing_of_many_files_takes_few_tasks(spark, tmp_path):
    tasks = 4 * spark.sparkContext.defaultParallelism
    for n in range(32 * tasks + 64):
        (tmp_path / f"{n}.txt").write_text("a")
    listed = list_pages(spark, f"{tmp_path}/*.txt")
    assert listed.count() == 32 * tasks + 64
    assert listed.select(F.spark_partition_id()).distinct().count() <= tasks


def test_page_folder_holds_a_file_for_each_id(spark, tmp_path):
    rows = [(1, "a"), (2, None), (None, "é"), (3, ""), (1, "b\n")]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    root = queries_rows.page_folder(spark, str(tmp_path))
    found = list_pages(spark, f"{root}/**/*.txt", "content").collect()
    got = {r.row_id.split("/")[0].split("=")[1]: bytes(r.content).decode() for r in found}
    assert len(found) == 4 and sorted(got.pop("1")) == sorted("a\nb\n\n")
    assert got == {"2": "\n", "3": "\n", "__HIVE_DEFAULT_PARTITION__": "é\n"}


@pytest.mark.parametrize("w,h,target", [(3000, 2000, 1540), (100, 1540, 1540), (5, 2, 1), (7, 3, 0),
                                        (1000, 5, 500), (3, 1000, 500)])
def test_resize_plan_is_half_to_even(spark, w, h, target):
    from pyspark.sql import functions as F

    got = spark.range(1).select(resize_plan(F.lit(w), F.lit(h), target).alias("s")).head().s
    want = (w, h)
    if target and max(w, h) != target:
        scale = target / max(w, h)
        want = (round(w * scale), round(h * scale))
    assert tuple(got) == want
