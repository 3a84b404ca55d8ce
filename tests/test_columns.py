"""Layout, profile and the values filled in from the data."""

from pyspark.sql import functions as F

from inferlake.functions import requests, responses
from inferlake.operators import dedup
from inferlake.operators.profile import column_profile, profile_order, text_column_choice
from inferlake.plans.resolve import resolve_table
from inferlake.sources.tables import layout, layout_choice, read_table, row_counts, scan


def pairs(spark, *rows):
    return spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(rows)],
                                 "ordinal bigint, config string, split string")


def test_layout_choice(spark):
    def pick(*rows):
        return tuple(layout_choice(pairs(spark, *rows)).head())

    assert pick(("web", "held")) == ("web", "held", "detected")
    assert pick(("extra", "train"), ("default", "dev"), ("default", "train")) == ("default", "train", "detected")
    assert pick(("z", "test"), ("a", "train"), ("z", "train")) == ("z", "train", "detected")
    assert pick(("z", "dev"), ("a", "train"), ("z", "test")) == ("z", "dev", "detected")
    assert pick() == ("default", "train", "default")


def profile(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "ordinal int, name string, avg_len double, uniq double")


def test_text_column_choice(spark):
    def pick(*rows):
        return tuple(text_column_choice(profile(spark, *rows)).head())

    assert pick(("headline", 55.5, None), ("abstract", 731.0, None), ("venue", 12.0, None)) == ("abstract", "detected")
    assert pick(("text", 8.0, 0.4), ("notes", 2500.0, 0.8)) == ("text", "detected")
    assert pick(("system", 900.0, 0.01), ("prompt", 30.0, 0.9)) == ("prompt", "detected")
    assert pick(("a", 10.0, 0.5), ("b", 10.0, 0.5)) == ("a", "detected")
    assert pick() == ("text", "default")


def test_profile_counts_null_as_empty(spark):
    df = spark.createDataFrame([("aa", None, 1), ("aa", "", 2), ("bbbb", "x", 3), (None, None, 4)],
                               "p string, q string, n int")
    got = [tuple(r) for r in column_profile(df).orderBy("ordinal").collect()]
    assert got == [(0, "p", 2.0, 0.75), (1, "q", 0.2, 0.5)]
    order = [r.name for r in column_profile(df).orderBy(*profile_order()).collect()]
    assert order == ["p", "q"]
    assert column_profile(spark.range(3)).count() == 0
    assert column_profile(df, preview_rows=1).count() == 2


def test_values_and_where_they_come_from(spark):
    df = spark.createDataFrame([("c", "dev", "long enough", "y"), ("c", "dev", "also long", "z")],
                               "config string, split string, body string, tag string")
    values, origin, _ = resolve_table(df, {})
    assert values == {"config": "c", "split": "dev", "column": "body"}
    assert set(origin.values()) == {"detected"}
    values, origin, _ = resolve_table(df, {"column": "tag", "split": "dev"})
    assert (values["column"], origin["column"], origin["config"]) == ("tag", "user", "detected")
    values, origin, _ = resolve_table(df.drop("config"), {})
    assert (values["config"], values["split"]) == ("default", "dev")
    values, origin, notes = resolve_table(spark.range(2), {})
    assert values == {"config": "default", "split": "train", "column": "text"}
    assert set(origin.values()) == {"default"} and "column" in notes


def test_scan_prunes_folders_and_columns(spark, tmp_path, plan_of):
    path = str(tmp_path / "t")
    df = spark.range(10).select("id", F.lit("x").alias("text"), F.lit("y").alias("other"),
                                F.when(F.col("id") < 3, "a").otherwise("b").alias("config"),
                                F.lit("train").alias("split"))
    df.write.partitionBy("config", "split").parquet(path)
    table = read_table(spark, path)
    picked = scan(table, ["id", "text"], "a", "train")
    assert picked.count() == 3
    assert "ReadSchema: struct<id:bigint,text:string>" in plan_of(picked)
    assert "PartitionFilters: [isnotnull(config" in plan_of(picked)
    assert {tuple(r) for r in row_counts(table).collect()} == {("a", "train", 3), ("b", "train", 7)}
    assert "ReadSchema: struct<>" in plan_of(row_counts(table))
    assert layout(table).count() == 2


def test_file_formats(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string")
    for fmt in ("parquet", "json", "csv", "orc"):
        path = str(tmp_path / f"t.{fmt}")
        df.write.format(fmt).option("header", "true").save(path)
        assert sorted(map(tuple, read_table(spark, path).select("id", "text").collect())) == [
            ("1", "a"), ("2", "b")]


def test_hot_content_is_spread_and_complete(spark):
    docs = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    copies = dedup.distinct_contents(docs, "text", "id")
    results = dedup.content_dedup(docs, "text", "id").select(
        "row_id", F.concat(F.lit("r:"), "text").alias("response"))
    joined = dedup.attach_to_all_rows(docs, "text", "id", results,
                                      copies.select("row_id", "n_copies"), 3000, hot_copies=100)
    rows = joined.collect()
    assert len(rows) == 3000 and all(r.response == "r:" + r.text for r in rows)
    assert {r.id for r in rows} == set(range(3000))


def test_no_salted_key_of_a_hot_content_is_large(spark):
    docs = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    copies = dedup.distinct_contents(docs, "text", "id").select("row_id", "n_copies")
    results = copies.select("row_id", F.lit("r").alias("response"))
    for size in (50, 400):
        joined = dedup.attach_to_all_rows(docs, "text", "id", results, copies, 6000, hot_copies=size, keep_salt=True)
        keys = joined.groupBy("row_id", "salt").count().agg(F.max("count"), F.sum("count")).first()
        assert keys[0] <= 2 * size and keys[1] == 6000


def test_bad_bodies_are_errors(spark):
    bodies = ["{}", None, "oops", '{"data":[{"embedding":[1.0]}]}', '{"choices":[]}',
              '{"choices":[{"message":{"content":"hi"}}],"usage":{"prompt_tokens":3}}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    texts = F.array(F.lit("t"))
    rows = df.select(responses.parse_embedding(texts, F.col("body")).alias("e"),
                     responses.parse_chat(F.col("body")).alias("c")).orderBy("i").collect()
    assert [r.e.error is None for r in rows] == [False, False, False, True, False, False]
    assert [r.c.error is None for r in rows] == [False] * 5 + [True]
    assert (rows[5].c.response, rows[5].c.prompt_tokens, rows[5].c.completion_tokens) == ("hi", 3, None)
    assert rows[3].e.prompt_tokens is None and rows[3].e.n_texts == 1


def test_requests(spark):
    row = spark.createDataFrame([("é\"x", None, bytearray(range(100)))],
                                "p string, q string, b binary").select(
        requests.chat_request("m", F.col("q"), 5, 0).alias("chat"),
        requests.embedding_request("m", F.array("p")).alias("embed"),
        requests.page_request("m", F.col("b")).alias("page")).head()
    assert row.chat == ('{"model":"m","messages":[{"role":"user","content":null}],'
                        '"max_tokens":5,"temperature":0.0}')
    assert row.embed == '{"model":"m","input":["é\\"x"]}'
    assert '"type":"text"' not in row.page and "\\r" not in row.page
