"""Every operator on the table of edge cases, and on an empty one."""

import random

import pytest
import public_tokenizers
from edge_tables import edge, empty, rows
from pyspark.sql import functions as F

import corpus_pipeline
from inferlake.llm import (decontam, huffman, hyperminhash, katz, lpf, mixing, pseudonyms, quality, templates,
                           toxicity)


def toxic_scores(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    return toxicity.score(docs, toxicity.train(docs, labels, F.lit(True)))


OPERATORS = {
    "katz": lambda docs: katz.katz_scores(docs, F.col("doc_id") % 3 == 1, order=3),
    "pseudonyms": lambda docs: pseudonyms.pseudonymise(docs, "key"),
    "toxicity": toxic_scores,
    "lpf": lambda docs: lpf.remove_repeats(docs, length=40),
    "tokens": lambda docs: huffman.written_and_read(docs, public_tokenizers.path("word_bpe_49k.json"), 1),
    "templates": lambda docs: templates.drop_templates(docs, min_docs=2),
    "mixing": mixing.mixing_plan,
    "near": hyperminhash.near_duplicates,
    "quality": quality.quality,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_result_for_each_row(spark, name):
    found = OPERATORS[name](edge(spark)).collect()
    assert len(found) == len(rows())
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](empty(spark)).count() == 0


def test_decontamination_of_edges(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, rows()[9 + 3][1][:200])], "item_id long, text string")
    found = decontam.matches(edge(spark), items).collect()
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in found] == [(9, None, 0)]
    assert decontam.matches(edge(spark), items.limit(0)).count() == 0
    assert decontam.matches(empty(spark), items).count() == 0
    assert decontam.drop_contaminated(edge(spark), items).count() == len(rows()) - 1


def test_extra_columns_stay(spark):
    docs = edge(spark)
    for out in (mixing.mix(docs), quality.quality(docs), hyperminhash.drop_near_duplicates(docs),
                pseudonyms.pseudonymise(docs, "k")):
        assert out.columns[:len(docs.columns)] == docs.columns
        assert {tuple(r[5:13]) for r in out.select(*docs.columns).collect()} == {rows()[0][5:]}


def test_mixed_documents_are_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = mixing.mix(docs)
    assert made.exceptAll(docs.unionByName(docs)).count() == 0 and made.columns == docs.columns
    targets = {r.source: (r.t, r.longest) for r in mixing.mixing_plan(docs).groupBy("source").agg(
        F.max(mixing.TARGET).alias("t"), F.max(mixing.SIZE).alias("longest")).collect()}
    for r in made.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect():
        assert abs(r.n - targets[r.source][0]) <= targets[r.source][1] / 2 + 1


def test_one_of_repeated_rows_stays(spark):
    kept = hyperminhash.drop_near_duplicates(edge(spark), percent=80).select("doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in kept if r["text"] and r["text"].startswith(rows()[0][1])) == [0]


def test_pipeline_stages_keep_columns(spark, tmp_path):
    docs = edge(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of the kind in any of the documents")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_quality_judges_rare_languages_by_themselves(spark, monkeypatch):
    def texts(lang, letters, documents, words):
        pick = random.Random(lang)
        return [(f"{lang}{k}", " ".join(pick.choice(letters) * 3 + str(pick.randrange(20)) for _ in range(words)), lang)
                for k in range(documents)]
    large = texts("en", "abcdefgh", 40, 4000)
    small = [*texts("xx", "éèêë", 6, 60), *texts(None, "ßüöä", 6, 60)]
    schema = "doc_id string, text string, lang string"
    alone = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(small, schema)).collect()}
    monkeypatch.setattr(quality, "MAX_LANGUAGES", 3)  # the two have far less than a third of the words, and of the documents
    together = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(large + small, schema)).collect()}
    assert len(together) == len(large) + len(small) and all(r["QR_kept"] for r in together.values())
    for key, r in alone.items():
        assert r.asDict() == pytest.approx(together[key].asDict())
    _, table = quality.references(spark.createDataFrame(large + small, schema))
    assert {r["QR_name"] for r in table.collect()} == {"sxx", "t"}


def test_short_items_are_weak_evidence(spark):
    items = spark.createDataFrame([(1, "B  c"), (2, "ne"), (3, "one"), (4, "a b c d"), (5, None), (6, " \n")], "item_id long, text string")
    found = decontam.matches(edge(spark), items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["begin"], r["end"]) for r in found) == [
        (6, 3, 0, 0, 3), (7, 3, 0, 0, 3), (8, 1, 0, 2, 5), (8, 4, 0, 0, 7)]
    assert all(r["weak"] for r in found)
    assert decontam.drop_contaminated(edge(spark), items).count() == len(rows())
    assert decontam.drop_contaminated(edge(spark), items, weak=True).count() == len(rows()) - 3
