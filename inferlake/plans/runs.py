"""Jobs from intent to a resumable run: embed, generate, ocr, status, publish."""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from itertools import islice

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferlake import models
from inferlake.operators import dedup, inference, progress as prog
from inferlake.operators.resume import pending
from inferlake.plans import generations, prepare
from inferlake.plans.resolve import resolve_table
from inferlake.session import temporary_stages
from inferlake.sources import claims, outputs, pages, sinks, tables
from inferlake.sources.storage import create_new, read_json
from inferlake.spec import JobSpec, SpecError

WAVE_UNITS = {"embeddings": 1_000_000, "generation": 5_000_000, "ocr": 20_000}
UNIT_GROUP_BYTES = 8 << 20
WAVES_AT_ONCE = 4       # small waves of pages, which mostly wait for listings and plans
RESULT_COLUMNS = {
    "embeddings": ("texts", "embeddings", "n_texts", "prompt_tokens"),
    "generation": ("response", "prompt_tokens", "completion_tokens"),
    "ocr": ("markdown", "model", "prompt_tokens", "completion_tokens"),
}


class NotFinishedError(RuntimeError):
    pass


@dataclass
class Progress:
    """The progress tables of one or many runs."""

    output: str
    files: DataFrame
    stats: DataFrame
    ticks: DataFrame
    records: DataFrame
    runs: DataFrame | None = None

    @property
    def world(self) -> DataFrame:
        return prog.world_size(self.files, self.stats, self.records)

    @property
    def progress(self) -> DataFrame:
        return prog.progress(self.stats, self.ticks, self.records, self._runs())

    @property
    def shards(self) -> DataFrame:
        return prog.known_shards(self.files, self.stats, self.records)

    @property
    def storage(self) -> DataFrame:
        counts = prog.storage_counts(self.files)
        return (self._runs().join(counts, "run", "left").join(self.world, "run", "left")
                .select("run", F.coalesce("parts", F.lit(0)).alias("parts"),
                        F.coalesce("orphans", F.lit(0)).alias("orphans"), "world",
                        F.coalesce("world_inferred", F.lit(False)).alias("world_inferred")))

    @property
    def telemetry(self) -> DataFrame:
        return prog.tick_window(self.files, self.ticks)

    @property
    def document(self) -> DataFrame:
        return prog.document(self.output, self.files, self.stats, self.ticks,
                             self.records, self._runs())

    def complete(self) -> bool:
        rows = prog.all_done(self.shards).agg(
            F.bool_and("complete"), F.count(F.lit(1))).head()
        return bool(rows[0]) and rows[1] > 0

    def _runs(self) -> DataFrame:
        found = self.files.select("run").distinct()
        if self.runs is None:
            return found
        return self.runs.select("run").unionByName(found).distinct()


def status(spark: SparkSession, output: str, audit: bool = False) -> Progress:
    """Progress of the run at ``output`` or of all runs below it (``parent/*``).

    Parts of this library's runs are known from their logs; ``audit`` looks at every file instead, which finds
    parts that someone else removed or added.
    """
    output = output.rstrip("/")
    runs = None
    if not output.endswith("/*"):   # a run that has written nothing still gets its row
        runs = spark.createDataFrame([(output.rsplit("/", 1)[-1],)], "run string")
    return Progress(output, outputs.list_outputs(spark, output, audit),
                    outputs.read_stats(spark, output), outputs.read_ticks(spark, output),
                    outputs.read_run_records(spark, output), runs)


@dataclass
class Run:
    """A launched run; everything else is read from its output."""

    spark: SparkSession
    spec: JobSpec
    record: dict

    @property
    def run_id(self) -> str:
        return self.record["run_id"]

    @property
    def output(self) -> str:
        return self.spec.output

    def status(self) -> Progress:
        return status(self.spark, self.output)

    def results(self, include_errors: bool = False) -> DataFrame:
        return sinks.read_healed(self.spark, self.output, include_errors)

    def all_rows(self, source: DataFrame | None = None, id_column: str | None = None) -> DataFrame:
        """Every row of the source with the answer to its content, copies included; for generation.

        ``source`` is read again from the spec's dataset unless given.
        """
        if self.spec.task != "generation":
            raise SpecError("only generation asks once for the copies of a content")
        key, column = id_column or self.spec.id_column, self.spec.column
        if key is None:
            raise SpecError("name the id column of the source's rows")
        if source is None:
            source = tables.read_table(self.spark, self.spec.dataset)
            source = tables.scan(source, [key, column], self.spec.config if "config" in source.columns else None,
                                 self.spec.split if "split" in source.columns else None)
        rows = source.select(key, column)
        answers = self.results(include_errors=True).select("row_id", *RESULT_COLUMNS["generation"], "error")
        copies = dedup.distinct_contents(rows, column, key).select("row_id", "n_copies")
        return dedup.attach_to_all_rows(rows, column, key, answers, copies, self.record.get("num_examples") or rows.count())

    def publish(self, target: str) -> str:
        return publish(self.spark, self.output, target, self.spec)


@dataclass
class RunPlan:
    """A checked job that has not run: the spec and the record it would leave."""

    spark: SparkSession
    spec: JobSpec
    record: dict
    source: DataFrame | None
    factory: Callable
    wave_units: int
    rows_per_file: int | None = None
    origin: dict = field(default_factory=dict)
    listed: DataFrame | None = None     # the page files, where a launch has listed them
    groups: int | None = None           # as the record has them

    def work(self) -> DataFrame:
        if self.spec.task == "embeddings":
            return prepare.embedding_work(self.source, self.spec, self.wave_units)
        if self.spec.task == "generation":
            return prepare.generation_work(self.source, self.spec, self.wave_units)
        return prepare.page_work(self.spark, self.spec, self.page_groups(), self.listed)

    def apply(self, units: DataFrame, wave: int | None = None, at_once: int = 1) -> DataFrame:
        """Results of some units; failures are rows with ``error``. ``wave`` is theirs, where all are of one, and
        ``at_once`` the number of waves that share the cores."""
        spec, s = self.spec, self.spec.settings
        if spec.task == "embeddings":
            return inference.embed_units(units, spec.model, self.factory)
        if spec.task == "generation":
            return inference.generate_rows(units, spec.column, spec.model, self.factory,
                                           spec.max_tokens, spec.temperature)
        # A wave is a group of paths by their hash: only its files are listed and opened, by their names.
        named = [] if wave is None else [r["path"] for r in units.select("path").limit(pages.NAMED + 1).collect()]
        if len(named) > pages.NAMED:
            named = []
        content = pages.read_group(self.spark, spec.dataset, self.page_groups(), wave, named, at_once)
        if named:       # so few units go to the tasks; else the pages' bytes might be shuffled
            units = F.broadcast(units)
        return inference.read_pages(
            units.join(content, "path"), "content", spec.model, self.factory,
            s.get("prompt"), spec.max_tokens, spec.temperature, s.get("top_p", 0.9)).drop("path")

    def page_groups(self) -> int:
        """Waves of a page run, fixed by the number of pages when it began."""
        if self.groups is None:
            groups, kept = generations.page_groups(self.spark, self.spec, self.wave_units, self.listed)
            if not kept:
                return groups
            self.groups = groups
        return self.groups

    def waves_at_once(self) -> int:
        """Waves under way together: as many small ones of pages as are one wave of the usual size, so that losing the
        driver loses no more than that."""
        if self.spec.task != "ocr":
            return 1
        return max(1, min(WAVES_AT_ONCE, WAVE_UNITS["ocr"] // self.wave_units))


def compile(spark: SparkSession, spec: JobSpec, *, source: DataFrame | None = None,
            model: Callable | None = None, wave_units: int | None = None,
            rows_per_file: int | None = None, resolved: dict | None = None) -> RunPlan:
    """Check a job and count its input; nothing is computed or written."""
    if spec.task != "ocr":
        source = tables.read_table(spark, spec.dataset) if source is None else source
        source = tables.scan(source, [c for c in source.columns],
                             spec.config if "config" in source.columns else None,
                             spec.split if "split" in source.columns else None)
        wanted = [c for c in (spec.id_column, spec.column) if c]
        absent = [c for c in wanted if c not in source.columns]
        if absent:
            raise SpecError(f"no column {', '.join(absent)} in {spec.dataset}")
        source = source.select(*wanted)
    identity = spec.identity()
    if spec.task != "ocr" and spec.num_examples is None:
        spec = spec.with_size(source.count())
    if spec.task != "ocr" and tables.files_of(source) is None:     # files are compared one by one
        identity["source"] = tables.fingerprint(source)
    return RunPlan(spark, spec, new_record(spec, identity, resolved or {}), source,
                   model or models.build(spec.model, spec.settings.get("model")),
                   wave_units or WAVE_UNITS[spec.task], rows_per_file)


def new_record(spec: JobSpec, identity: dict, resolved: dict, world: int | None = None) -> dict:
    """What ``run.json`` says of a run; its keys are fixed by the storage contract."""
    return {
        "version": 1, "task": spec.task, "run_id": uuid.uuid4().hex[:8],
        "slug": spec.task, "spec": spec.to_dict(), "identity": identity,
        "expected_rows": spec.expected_rows, "items_per_row": spec.batch,
        "expected_items": spec.expected_items, "world": world or spec.world,
        "num_examples": spec.num_examples, "jobs": [], "created_at": None,
        "resolved": resolved,
    }


def _staged_work(plan: RunPlan) -> DataFrame:
    """Work units of the run, written once under the output: a resume reads them back and
    never cleans, numbers or batches the source again. What files were added to the source since then
    becomes a further generation of units.

    Launches of different shards may start together: one of them stages, the others wait for it.
    """
    spark, output = plan.spark, plan.spec.output
    with temporary_stages(spark):
        try:
            ledger = generations.current_files(plan)
            change = generations.compare(spark, output, ledger)
            if change.grown:
                with claims.only_one(spark, output, "plan", lambda: not generations.compare(spark, output, ledger).grown) as mine:
                    if mine:
                        generations.stage_units(plan, change, ledger)
        finally:
            plan.listed = None      # deleted with the stages
    return generations.read_units(spark, output)


def open_record(spark: SparkSession, spec: JobSpec, planned: dict) -> dict:
    """Write the run record, or take up the one that is there if it means the same work."""
    path = f"{spec.output}/run.json"
    record = {**planned, "created_at": dt.datetime.now(dt.timezone.utc).isoformat()}
    if read_json(spark, path) is None and create_new(spark, path, json.dumps(record)):
        return record
    before = read_json(spark, path)
    changed = [k for k, v in planned["identity"].items() if before.get("identity", {}).get(k) != v]
    changed += [k for k in ("wave_units", "world") if before.get(k, planned.get(k)) != planned.get(k)]
    if changed:
        raise SpecError(f"{spec.output} holds a run with other {', '.join(changed)}; "
                        "ids would not mean the same rows")
    return before


def _runs_of(ranks: list[int]) -> list[list[int]]:
    """Ranks in groups of neighbours, each small enough for one commit."""
    groups: list[list[int]] = []
    for rank in ranks:
        if not groups or groups[-1][-1] + 1 != rank or len(groups[-1]) == sinks.OBSERVED_RANKS:
            groups.append([])
        groups[-1].append(rank)
    return groups


def launch(plan: RunPlan, ranks: list[int] | None = None, take_over: bool = False) -> Run:
    """Run what is not done yet, one commit per wave. Calling it again resumes.

    With ``ranks`` only these shards run; other launches may run the other shards at the same time. A shard that
    a live launch works on is refused with ``ClaimedError``; ``take_over`` says that the other launch is dead.
    """
    spark, spec = plan.spark, plan.spec
    mine = sorted(set(range(spec.world) if ranks is None else ranks))
    if not mine or mine[0] < 0 or mine[-1] >= spec.world:
        raise SpecError(f"ranks must be among 0 to {spec.world - 1}")
    plan.record["wave_units"] = plan.wave_units
    record = open_record(spark, spec, plan.record)
    with claims.held(spark, spec.output, [f"rank-{r}" for r in mine], take_over=take_over):
        work = _staged_work(plan)
        sinks.adopt_orphans(spark, spec.output, None if len(mine) == spec.world else mine)
        _run_shards(plan, work, mine)
    run = Run(spark, spec, read_json(spark, f"{spec.output}/run.json") or record)
    if spec.publish and run.status().complete():
        run.publish(spec.publish)
    return run


def _run_shards(plan: RunPlan, work: DataFrame, ranks: list[int]) -> None:
    """Commit the open waves of some shards; a shard's stats and marker follow its last commit."""
    spark, spec = plan.spark, plan.spec
    attempt, started = sinks.new_attempt(spark, spec.output), time.monotonic()
    planned, before = _counts(spark, spec.output, ranks)
    written: dict[int, dict] = {r: dict.fromkeys(sinks.COUNTS, 0) for r in ranks}
    ticks: dict[int, list[dict]] = {}
    todo = []
    for wave in sorted({w for w, _ in planned}):
        for group in _runs_of(ranks):
            left = [r for r in group if (wave, r) in planned
                    and before.get((wave, r), {}).get("ok", 0) < planned[wave, r]["units"]]
            todo += [(wave, some) for some in _runs_of(left)]

    def finish(done: list[int]) -> None:
        if done:
            stats = [_shard_stats(spec, r, planned, before, written[r], time.monotonic() - started) for r in done]
            sinks.write_completions(spark, spec.output, stats)

    def commit(wave: int, group: list[int]) -> tuple[str, list[dict]]:
        units = work.where((F.col("wave") == wave) & F.col("rank").isin(group))
        if any(before.get((wave, r), {}).get("units") for r in group):    # some of it is done
            units = pending(units, sinks.done_ids(spark, spec.output).where(F.col("wave") == wave))
        results = plan.apply(units, wave, at_once).withColumn("attempt", F.lit(attempt))
        part = sinks.part_name(attempt, wave, (group[0], group[-1]))
        return part, sinks.commit(results, spec.output, part, plan.rows_per_file, wave, group, attempt)

    entries = []
    left = Counter(r for _, group in todo for r in group)     # commits that a shard waits for
    finish([r for r in ranks if r not in left])
    at_once, further, running = max(1, min(plan.waves_at_once(), len(todo))), iter(todo), {}
    # Threads commit; ticks, stats and markers are written here alone. When a wave fails none is begun any more, and
    # those under way end before the claims do.
    threaded = inheritable_thread_target(spark)(commit)
    with ThreadPoolExecutor(at_once) as pool:
        while True:
            for wave, group in islice(further, at_once - len(running)):
                running[pool.submit(threaded, wave, group)] = group
            if not running:
                break
            for ended in wait(running, return_when=FIRST_COMPLETED).done:
                group = running.pop(ended)
                part, cells = ended.result()
                entries.append({"part": part, "attempt": attempt, "cells": cells})
                elapsed = time.monotonic() - started
                for cell in cells:
                    for c in sinks.COUNTS:
                        written[cell["rank"]][c] += cell[c]
                _tick(spark, spec.output, cells, attempt, elapsed, ticks)
                left.subtract(group)
                finish([r for r in group if not left[r]])
    if entries:
        sinks.fold_log(spark, spec.output, attempt, entries)


def _counts(spark: SparkSession, output: str, ranks: list[int]) -> tuple[dict, dict]:
    """Units that are planned, and counts that are committed, per (wave, shard): one row each is collected, and no
    id is read."""
    planned = {(r["wave"], r["rank"]): r.asDict() for r in
               generations.read_counts(spark, output).where(F.col("rank").isin(ranks)).collect()}
    sums = [F.sum(c).alias(c) for c in ("units", "ok")]
    done = sinks.log_counts(spark, output).where(F.col("rank").isin(ranks)).groupBy("wave", "rank").agg(*sums)
    return planned, {(r["wave"], r["rank"]): r.asDict() for r in done.collect()}


def _tick(spark: SparkSession, output: str, cells: list[dict], attempt: int, elapsed: float,
          ticks: dict[int, list[dict]]) -> None:
    """One telemetry line per shard of the commit, so that progress shows while a run is on."""
    for cell in cells:
        log = ticks.setdefault(cell["rank"], [])
        since = elapsed - (log[-1]["t"] if log else 0.0)
        tokens = cell["prompt_tokens"] + cell["completion_tokens"]
        log.append({"t": round(elapsed, 3), "ok": cell["ok"], "tok_s": round(tokens / max(since, 1e-3), 1)})
        sinks.write_ticks(spark, output, cell["rank"], attempt, log)


def _shard_stats(spec: JobSpec, rank: int, planned: dict, before: dict, written: dict, elapsed: float) -> dict:
    """What a shard's stats file says, from counts that are at hand."""
    own = [c for (_, r), c in planned.items() if r == rank]
    tokens = written["prompt_tokens"] + written["completion_tokens"]
    return {"rank": rank, "world": spec.world, "rows_total": sum(c["units"] for c in own),
            "rows_deduped": sum(c["dropped"] for c in own),
            "rows_done_prior": sum(c["ok"] for (_, r), c in before.items() if r == rank),
            "rows_processed": written["units"], "rows_failed": written["units"] - written["ok"],
            "prompt_tokens": written["prompt_tokens"], "completion_tokens": written["completion_tokens"],
            "elapsed_s": elapsed, "tokens_per_sec": tokens / elapsed if elapsed else None}


def publish(spark: SparkSession, output: str, target: str,
            spec: JobSpec | None = None) -> str:
    """Write a clean copy of a finished output to a path (``/`` in it) or a table.

    Without a spec the task comes from the run's record; an output without one keeps its columns.
    """
    if not status(spark, output).complete():
        raise NotFinishedError(f"not all shards of {output} are done")
    record = {"task": spec.task, "spec": spec.to_dict()} if spec else read_json(spark, f"{output}/run.json")
    clean = sinks.read_healed(spark, output)
    if record:
        task = record["task"]
        extra = {"embeddings": ("member_ids",), "generation": (record["spec"]["column"],)}.get(task, ())
        clean = clean.select("row_id", *extra, *RESULT_COLUMNS[task])
    if "/" in target:
        clean.write.parquet(target)
    else:
        clean.write.saveAsTable(target)
    return target


def _verb(spark: SparkSession, task: str, dataset: str | DataFrame, launch_now: bool,
          model: str | None, factory: Callable | None, options: dict, **given):
    source, origin, notes = None, {"dataset": "user"}, {}
    if task != "ocr":
        source = tables.read_table(spark, dataset)
        values, more, notes = resolve_table(source, given)
        origin.update(more)
        given = {**given, **values}
    origin.update({k: "user" for k, v in given.items() if v is not None and k not in origin})
    spec = JobSpec(task=task, dataset=dataset if isinstance(dataset, str) else "dataframe",
                   model=model, **{k: v for k, v in given.items() if v is not None})
    plan = compile(spark, spec, source=source, model=factory,
                   resolved={"provenance": origin, "notes": notes}, **options)
    return launch(plan) if launch_now else plan


def embed(spark: SparkSession, dataset: str | DataFrame, *, output: str,
          model: str = "hash-embedder", factory: Callable | None = None,
          launch: bool = True, wave_units: int | None = None,
          rows_per_file: int | None = None, **given) -> Run | RunPlan:
    """Embed a text column. config, split and column come from the data unless given;
    also takes id_column, batch, world, limit, truncate, publish, settings."""
    return _verb(spark, "embeddings", dataset, launch, model, factory,
                 {"wave_units": wave_units, "rows_per_file": rows_per_file},
                 output=output, **given)


def generate(spark: SparkSession, dataset: str | DataFrame, *, model: str, output: str,
             factory: Callable | None = None, launch: bool = True,
             wave_units: int | None = None, rows_per_file: int | None = None,
             **given) -> Run | RunPlan:
    """One answer per distinct prompt. The model has no default."""
    return _verb(spark, "generation", dataset, launch, model, factory,
                 {"wave_units": wave_units, "rows_per_file": rows_per_file},
                 output=output, **given)


def ocr(spark: SparkSession, glob: str, *, output: str, model: str,
        factory: Callable | None = None, launch: bool = True,
        wave_units: int | None = None, rows_per_file: int | None = None,
        **given) -> Run | RunPlan:
    """Page files under a glob to markdown; ids are paths, so a resume is per page."""
    given.setdefault("max_tokens", 4096)
    given.setdefault("temperature", 0.2)
    return _verb(spark, "ocr", glob, launch, model, factory,
                 {"wave_units": wave_units, "rows_per_file": rows_per_file},
                 output=output, **given)
