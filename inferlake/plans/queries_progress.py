"""Registered queries: progress of many runs. The run folders are derived from ``events``:
a user is a run, an event a tick, and file names, stats and records follow from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from inferlake.functions.files import file_kind
from inferlake.operators import progress as prog
from inferlake.plans.queries_rows import table


def _ticks(spark, sf_dir):
    rank, epoch = F.col("event_id") % 4, F.dayofmonth("ts")
    return table(spark, sf_dir, "events").select(
        F.format_string("run-%d", "user_id").alias("run"), rank.cast("int").alias("rank"),
        epoch.cast("bigint").alias("epoch"),
        F.format_string("telemetry-shard%d-%d.jsonl", rank, epoch).alias("rel_path"),
        F.col("event_id").alias("line"), F.floor("value").cast("bigint").alias("ok"))


def _stats(spark, sf_dir):
    done = table(spark, sf_dir, "events").where("event_type = 'purchase' AND user_id % 3 <> 0")
    return done.groupBy(F.format_string("run-%d", "user_id").alias("run"),
                        (F.col("event_id") % 4).cast("int").alias("rank")).agg(
        F.count_if(F.col("value") < 10).alias("rows_done_prior"),
        F.count(F.lit(1)).alias("rows_processed"),
        F.count_if(F.col("value") > 100).alias("rows_failed"),
        F.max(F.when(F.col("user_id") % 4 != 1, 4 + F.col("user_id") % 2))
        .cast("int").alias("world"))


def _records(spark, sf_dir):
    runs = table(spark, sf_dir, "events").where("user_id % 5 <> 0").groupBy("user_id").count()
    return runs.select(
        F.format_string("run-%d", "user_id").alias("run"),
        F.when(F.col("user_id") % 7 != 0, F.col("count") * 2).otherwise(0)
        .alias("expected_rows"),
        F.when(F.col("user_id") % 2 == 0, 64).alias("items_per_row"),
        (F.col("count") * 128).alias("expected_items"),
        F.when(F.col("user_id") % 4 != 0, 5).alias("world"))


def _files(spark, sf_dir):
    """Paths a run would hold, then classified by name alone."""
    shards = _ticks(spark, sf_dir).groupBy("run", "rank").agg(
        F.collect_set("epoch").alias("days"))       # at most 31 days of a month

    def path(pattern, *columns):
        return F.format_string(pattern, *columns)

    def per_day(pattern, *, day_first=False):
        return F.transform("days", lambda day: path(
            pattern, *((day, F.col("rank")) if day_first else (F.col("rank"), day))))

    none = F.array().cast("array<string>")
    paths = shards.select("run", F.explode(F.concat(
        per_day("telemetry-shard%d-%d.jsonl"),
        per_day("part-%d-%05d.parquet", day_first=True),
        F.when(F.col("rank") != 3, per_day("_manifest/ids-part-%d-%05d.parquet", day_first=True))
        .otherwise(none),
        F.when(F.col("rank") <= 1, F.array(path("completions/shard-%d.done", F.col("rank"))))
        .otherwise(none))).alias("rel_path"))
    return (paths.select("run", "rel_path", file_kind(F.col("rel_path")).alias("k"))
            .select("run", "rel_path", "k.*"))


SQL_TABLES = """
ticks AS (
  SELECT 'run-' || user_id AS run, CAST(event_id % 4 AS INTEGER) AS rank, day(ts) AS epoch,
         event_id AS line, CAST(floor(value) AS BIGINT) AS ok FROM events),
stats AS (
  SELECT 'run-' || user_id AS run, CAST(event_id % 4 AS INTEGER) AS rank,
         CAST(count_if(value < 10) AS BIGINT) AS rows_done_prior, count(*) AS rows_processed,
         CAST(count_if(value > 100) AS BIGINT) AS rows_failed,
         CAST(max(CASE WHEN user_id % 4 <> 1 THEN 4 + user_id % 2 END) AS INTEGER) AS world
  FROM events WHERE event_type = 'purchase' AND user_id % 3 <> 0 GROUP BY user_id, event_id % 4),
records AS (
  SELECT 'run-' || user_id AS run,
         CASE WHEN user_id % 7 <> 0 THEN count(*) * 2 ELSE 0 END AS expected_rows,
         CASE WHEN user_id % 2 = 0 THEN 64 END AS items_per_row,
         count(*) * 128 AS expected_items, CASE WHEN user_id % 4 <> 0 THEN 5 END AS world
  FROM events WHERE user_id % 5 <> 0 GROUP BY user_id),
runs AS (SELECT DISTINCT run FROM ticks),
days AS (SELECT DISTINCT run, rank, epoch FROM ticks),
seen AS (SELECT DISTINCT run, rank FROM ticks UNION SELECT run, rank FROM stats),
worlds AS (
  SELECT r.run, s.w AS by_stats, k.world AS by_record, k.run IS NOT NULL AS has_record, m.top
  FROM runs r LEFT JOIN (SELECT run, arg_min_null(world, rank) AS w FROM stats GROUP BY run) s
         USING (run)
  LEFT JOIN records k USING (run)
  LEFT JOIN (SELECT run, max(rank) AS top FROM seen GROUP BY run) m USING (run)),
world_size AS (
  SELECT run, coalesce(by_stats, CASE WHEN has_record THEN by_record ELSE top + 1 END) AS world,
         by_stats IS NULL AND NOT has_record AND top IS NOT NULL AS world_inferred FROM worlds)"""


def _progress(spark, sf_dir, stats):
    return prog.progress(stats, _ticks(spark, sf_dir), _records(spark, sf_dir))


def progress_exact(spark, sf_dir):
    return _progress(spark, sf_dir, _stats(spark, sf_dir))


def progress_approx(spark, sf_dir):
    """The same runs before any shard has written its stats."""
    return _progress(spark, sf_dir, _stats(spark, sf_dir).where(F.lit(False)))


SQL_PROGRESS = """
s AS (SELECT run, CAST(sum(rows_done_prior + rows_processed) AS BIGINT) AS n,
             CAST(sum(rows_failed) AS BIGINT) AS failed FROM {stats} GROUP BY run),
t AS (SELECT run, CAST(sum(ok) AS BIGINT) AS n FROM ticks GROUP BY run),
p AS (SELECT runs.run, coalesce(s.n, t.n, 0) AS rows_ok, s.failed AS rows_failed,
             s.run IS NOT NULL AS exact, k.* EXCLUDE (run, world),
             k.run IS NOT NULL AS has_run_json
      FROM runs LEFT JOIN s USING (run) LEFT JOIN t USING (run) LEFT JOIN records k USING (run))
SELECT run, rows_ok, rows_failed, expected_rows,
       CASE WHEN expected_rows <> 0
            THEN least(1.0::DOUBLE, rows_ok::DOUBLE / expected_rows) END AS pct,
       exact, items_per_row, rows_ok * items_per_row AS items_ok, expected_items, has_run_json
FROM p"""


def world_size(spark, sf_dir):
    return prog.world_size(_files(spark, sf_dir), _stats(spark, sf_dir), _records(spark, sf_dir))


def shard_roster(spark, sf_dir):
    files, stats = _files(spark, sf_dir), _stats(spark, sf_dir)
    roster = prog.shard_roster(files, stats,
                               prog.world_size(files, stats, _records(spark, sf_dir)))
    return roster.select("run", "rank", "done", "stats.rows_processed", "stats.rows_failed")


def runs_complete(spark, sf_dir):
    files, stats = _files(spark, sf_dir), _stats(spark, sf_dir)
    return prog.all_done(prog.shard_roster(
        files, stats, prog.world_size(files, stats, _records(spark, sf_dir))))


SQL_ROSTER = """
ranks AS (SELECT run, rank FROM seen
          UNION SELECT run, CAST(unnest(range(world)) AS INTEGER) FROM world_size WHERE world > 0),
roster AS (
  SELECT r.run, r.rank, d.run IS NOT NULL AS done, s.rows_processed, s.rows_failed
  FROM ranks r LEFT JOIN stats s USING (run, rank)
  LEFT JOIN (SELECT DISTINCT run, rank FROM ticks WHERE rank <= 1) d USING (run, rank))"""


def orphans(spark, sf_dir):
    return prog.orphan_parts(_files(spark, sf_dir))


def storage_counts(spark, sf_dir):
    return prog.storage_counts(_files(spark, sf_dir))


def file_kinds(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("run", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("max_rank"),
        F.max("epoch").alias("max_epoch"))


def tick_window(spark, sf_dir):
    return prog.tick_window(_files(spark, sf_dir), _ticks(spark, sf_dir)).select(
        "run", "rank", "epoch", "line", "ok")


def shard_stats(spark, sf_dir):
    units = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), (F.col("user_id") % 4).cast("int").alias("rank"),
        (F.col("event_id") % 3 == 0).alias("done_prior"),
        F.when(F.col("value") > 100, "timeout").alias("error"),
        (F.col("event_id") % 2).alias("copies_dropped"),
        F.floor("value").cast("bigint").alias("prompt_tokens"),
        F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("completion_tokens"))
    return prog.with_token_rate(prog.shard_stats(units).withColumn("elapsed_s", F.lit(60.0)))


def progress_document(spark, sf_dir):
    """The one-document form of every run, with the tick fields the events do not have empty."""
    ticks = _ticks(spark, sf_dir)
    for name in ("t", "limit", "inflight", "waiting", "running", "bp", "input_bound", "tok_s"):
        ticks = ticks.withColumn(name, F.lit(None).cast("bigint"))
    records = (_records(spark, sf_dir).withColumn("run_id", F.col("run"))
               .withColumn("spec", F.lit(None).cast("string")))
    docs = prog.document("events", _files(spark, sf_dir), _stats(spark, sf_dir), ticks, records)
    body = F.from_json("document", "version int, progress struct<rows_ok:bigint>, "
                       "shards array<struct<rank:int>>, "
                       "storage struct<parts:bigint,orphans:bigint,world:int>, "
                       "telemetry map<string,array<struct<ok:bigint>>>")
    return docs.select("run", body.alias("d")).select(
        "run", "d.version", "d.progress.rows_ok",
        F.size("d.shards").cast("bigint").alias("n_shards"),
        "d.storage.parts", "d.storage.orphans", "d.storage.world",
        F.aggregate(F.flatten(F.map_values("d.telemetry")), F.lit(0).cast("bigint"),
                    lambda acc, tick: acc + tick["ok"]).alias("window_ok"))


SQL_WINDOW = """
newest AS (SELECT run, rank, max(epoch) AS epoch FROM ticks GROUP BY run, rank),
tail AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.run, t.rank ORDER BY line DESC) AS n
  FROM ticks t JOIN newest USING (run, rank, epoch))"""

QUERIES = {
    "progress_exact": (progress_exact,
                       f"WITH {SQL_TABLES}, {SQL_PROGRESS.format(stats='stats')}"),
    "progress_approx": (progress_approx, f"WITH {SQL_TABLES}, "
                        + SQL_PROGRESS.format(stats="(SELECT * FROM stats WHERE false)")),
    "world_size": (world_size, f"WITH {SQL_TABLES} SELECT * FROM world_size"),
    "shard_roster": (shard_roster, f"WITH {SQL_TABLES}, {SQL_ROSTER} SELECT * FROM roster"),
    "runs_complete": (runs_complete, f"""WITH {SQL_TABLES}, {SQL_ROSTER}
        SELECT run, bool_and(done) AS complete FROM roster GROUP BY run"""),
    "orphans": (orphans, f"""WITH {SQL_TABLES}
        SELECT run, printf('part-%d-%05d.parquet', epoch, rank) AS part
        FROM days WHERE rank = 3"""),
    "storage_counts": (storage_counts, f"""WITH {SQL_TABLES}
        SELECT run, count(*) AS parts, CAST(count_if(rank = 3) AS BIGINT) AS orphans
        FROM days GROUP BY run"""),
    "file_kinds": (file_kinds, f"""WITH {SQL_TABLES}
        SELECT run, 'telemetry' AS kind, count(*) AS n, max(rank) AS max_rank,
               max(epoch) AS max_epoch FROM days GROUP BY run
        UNION ALL SELECT run, 'part', count(*), NULL, NULL FROM days GROUP BY run
        UNION ALL SELECT run, 'manifest', count(*), NULL, NULL
        FROM days WHERE rank <> 3 GROUP BY run
        UNION ALL SELECT run, 'marker', count(*), max(rank), NULL
        FROM (SELECT DISTINCT run, rank FROM ticks WHERE rank <= 1) GROUP BY run"""),
    "tick_window": (tick_window, f"""WITH {SQL_TABLES}, {SQL_WINDOW}
        SELECT run, rank, epoch, line, ok FROM tail WHERE n <= 120"""),
    "shard_stats": (shard_stats, """SELECT event_type AS run, CAST(user_id % 4 AS INTEGER) AS rank,
        count(*) AS rows_total, CAST(count_if(event_id % 3 = 0) AS BIGINT) AS rows_done_prior,
        CAST(count_if(event_id % 3 <> 0) AS BIGINT) AS rows_processed,
        CAST(count_if(value > 100) AS BIGINT) AS rows_failed,
        CAST(sum(event_id % 2) AS BIGINT) AS rows_deduped,
        CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS prompt_tokens,
        CAST(sum(CASE WHEN event_id % 5 <> 0 THEN user_id END) AS BIGINT) AS completion_tokens,
        60.0::DOUBLE AS elapsed_s,
        (sum(CAST(floor(value) AS BIGINT))
         + sum(CASE WHEN event_id % 5 <> 0 THEN user_id ELSE 0 END))::DOUBLE / 60.0
          AS tokens_per_sec
        FROM events GROUP BY event_type, user_id % 4"""),
    "progress_document": (progress_document, f"""WITH {SQL_TABLES}, {SQL_ROSTER}, {SQL_WINDOW},
        s AS (SELECT run, sum(rows_done_prior + rows_processed) AS n FROM stats GROUP BY run),
        t AS (SELECT run, sum(ok) AS n FROM ticks GROUP BY run),
        d AS (SELECT run, count(*) AS parts, CAST(count_if(rank = 3) AS BIGINT) AS orphans
              FROM days GROUP BY run),
        r AS (SELECT run, count(*) AS n_shards FROM roster GROUP BY run),
        w AS (SELECT run, sum(ok) AS n FROM tail WHERE n <= 120 GROUP BY run)
        SELECT run, 1 AS version, CAST(coalesce(s.n, t.n) AS BIGINT) AS rows_ok, n_shards,
               parts, orphans, world, CAST(w.n AS BIGINT) AS window_ok
        FROM runs LEFT JOIN s USING (run) LEFT JOIN t USING (run) LEFT JOIN d USING (run)
        LEFT JOIN r USING (run) LEFT JOIN w USING (run) LEFT JOIN world_size USING (run)"""),
}
