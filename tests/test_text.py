from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inferlake.functions.text import WHITESPACE, clean_text, stripped

EDGES = [None, "", " ", "　", " x ", "a b", "\x1c\x1fmid   dle\x85", "​kept",
         "\n\n  text\t", "é ", "﻿bom", "😀 " * 700, " " * 1300 + "z", "y" * 1199 + "  " + "z"]


def cleaned_in_python(texts, limit=None):
    kept = ((t or "").strip() for t in texts)
    return [t[:limit] for t in kept if t]


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    return [r["text"] for r in clean_text(df, "text").orderBy("id").collect()]


def test_whitespace_is_what_python_strips():
    assert all(not c.strip() for c in WHITESPACE) and "　" in WHITESPACE


def test_edge_texts(spark):
    assert run(spark, EDGES) == cleaned_in_python(EDGES)


@settings(max_examples=15, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list(WHITESPACE) + list("aé😀​")),
                        max_size=12), min_size=1, max_size=30))
def test_random_texts(spark, texts):
    assert run(spark, texts) == cleaned_in_python(texts)


def test_null_counts_as_empty(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(stripped(F.col("text"))).head()[0] == ""


def test_filter_reaches_the_scan(spark, plan_of):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = plan_of(clean_text(docs.select("doc_id", "text"), "text"))
    assert "PushedFilters: [IsNotNull(text)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_large_batches_become_python_objects_a_few_megabytes_at_a_time():
    import pyarrow as pa

    from inferlake.operators.inference import PIECE_BYTES, _pieces

    batch = pa.array([[f"{n}" * 1000] * 10 for n in range(1000, 2000)], pa.list_(pa.string()))    # 40 MB
    pieces = list(_pieces(iter([batch, batch.slice(0, 0), batch.slice(0, 3)]), 8))
    assert max(p.nbytes for p in pieces) <= 1.1 * PIECE_BYTES and all(len(p) % 8 == 0 for p in pieces[:-1])
    assert [v for p in pieces for v in p.to_pylist()] == [*batch.to_pylist(), *batch.slice(0, 3).to_pylist()]


def test_batches_of_several_pieces_give_every_result(spark):
    from pyspark.sql import functions as F

    from inferlake.models import build
    from inferlake.operators import inference

    rows = spark.range(64).select("id", F.repeat(F.lit("word "), 100_000).alias("text")).coalesce(1)
    got = inference.generate_rows(rows, "text", "echo", build("echo")).where("error is null")
    assert got.select(F.sum("prompt_tokens")).head()[0] == 64 * 500_000
    units = rows.select("id", F.array("text", "text").alias("texts"))
    got = inference.embed_units(units, "hash-embedder", build("hash-embedder")).agg(F.sum("n_texts"), F.sum("prompt_tokens")).head()
    assert tuple(got) == (128, 128 * 100_000)
