"""Parts of the operators on their own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inferlake.llm import bitmap, huffman, hyperminhash, pseudonyms, toxicity
from inferlake.llm.components import components
from inferlake.llm.queries_toxicity import op3_toxicity


@pytest.mark.parametrize("symbols", [1, 2, 3, 700])
def test_huffman_round_trip_and_lengths(symbols):
    pick = np.random.default_rng(symbols)
    counts = pick.zipf(1.4, symbols).clip(1, 10**8)
    bits = huffman.code_lengths(counts, 12)
    assert bits.max() <= 12 and (symbols == 1 or (2.0 ** -bits).sum() == 1)
    codes = huffman.Codes(pick.choice(49408, symbols, replace=False), bits)
    for size in (0, 1, huffman.STRIDE, 5 * huffman.STRIDE + 3):
        tokens = pick.choice(codes.ids, size)
        payload, offsets = codes.encode(tokens)
        assert (codes.decode(payload, offsets, size) == tokens).all()


def test_unlimited_lengths_are_optimal():
    assert sorted(huffman.code_lengths(np.array([1, 1, 2, 4, 8]), 10).tolist()) == [1, 2, 3, 4, 4]
    assert sorted(huffman.code_lengths(np.array([1, 1, 2, 4, 8]), 3).tolist()) == [1, 3, 3, 3, 3]


@pytest.mark.parametrize("jaccard", [0.3, 0.8, 0.9])
def test_jaccard_estimates(jaccard):
    pick = np.random.default_rng(5)
    off = []
    for _ in range(20):
        n = 400
        common = int(2 * n * jaccard / (1 + jaccard))
        values = pick.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
        a, b = np.sort(values[:n]), np.sort(values[n - common:])
        regs = hyperminhash.registers(np.concatenate([a, b]), np.array([0, n]))
        off.append(hyperminhash.estimate((regs[0] == regs[1]).sum(keepdims=True), np.array([n]))[0] - jaccard)
    assert abs(np.mean(off)) < 0.03


def test_links_of_blocks():
    pick = random.Random(3)
    base = [pick.randrange(2**63) for _ in range(100)]
    sets = [np.array(sorted(pick.sample(base, 92) + [pick.randrange(2**63) for _ in range(pick.randrange(12))]), dtype=np.uint64)
            for _ in range(40)]
    regs = np.stack([hyperminhash.registers(s, np.array([0]))[0] for s in sets])
    edges = hyperminhash.link_block(sets, regs, np.zeros(40), 85)

    def groups(links):
        label = list(range(40))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i in range(40) if label[i] == g) for g in label}
    full = [(a, b) for a in range(40) for b in range(a) if 100 * (i := len(set(sets[a]) & set(sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - i)]
    assert groups(edges) == groups(full)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"t{i}" for i in range(200) if i != k)) for k in range(60)], "doc_id long, text string")
    whole = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(docs, 85).collect()}
    monkeypatch.setattr(hyperminhash, "BLOCK_SHINGLES", 1000)
    assert {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(docs, 85).collect()} == whole
    assert set(whole.values()) == {0}


@pytest.fixture
def no_small_tables(spark):
    """Tables are joined as if none were small enough to be sent to all tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moved_rows(plan, column):
    """Rows that the exchanges of a plan that has run wrote with ``column``."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return moved_rows(plan.executedPlan(), column)
    if kind.endswith("QueryStageExec"):
        return moved_rows(plan.plan(), column)
    below = plan.children()
    own = kind == "ShuffleExchangeExec" and f"{column}#" in plan.output().toString()
    return (plan.metrics().apply("shuffleRecordsWritten").value() if own else 0) + sum(
        moved_rows(below.apply(k), column) for k in range(below.size()))


@pytest.mark.parametrize("bits", [8, 26])
def test_rows_without_keys(spark, monkeypatch, no_small_tables, bits):
    monkeypatch.setattr(bitmap, "BITS", bits)  # in 256 bits most rows seem to be among the keys
    rows = spark.createDataFrame([(k if k % 9 else None, f"t{k}", "x", "y") for k in range(3000)] * 2,
                                 "doc_id long, text string, bucket string, bits string")
    keys = spark.range(0, 6000, 5).withColumnRenamed("id", "doc_id")
    found = bitmap.without(rows, keys, "doc_id")
    assert found.columns == rows.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.join(keys, "doc_id", "left_anti").select(rows.columns).collect()))
    if bits == 26:
        assert moved_rows(found._jdf.queryExecution().executedPlan(), "text") < 30
    assert bitmap.without(rows, keys.limit(0), "doc_id").count() == 6000
    names = rows.withColumn("doc_id", rows.doc_id.cast("string"))
    assert bitmap.without(names, names.select("doc_id"), "doc_id").count() == rows.filter("doc_id is null").count()


def test_near_duplicates_go_where_they_lie(spark, no_small_tables, tmp_path):
    texts = [" ".join(f"g{k // 3}w{i}" for i in range(40)) for k in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    kept = hyperminhash.drop_near_duplicates(spark.read.parquet(f"{tmp_path}/docs"), percent=80)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 300, 3))
    assert moved_rows(kept._jdf.queryExecution().executedPlan(), "text") < 10


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_kernel_tolerates_gaps():
    def similar(a, b):
        a, b = (np.stack([toxicity.code_word(x)]) for x in (a, b))
        k = toxicity.subsequence_kernel
        return float(k(a, b)[0] / np.sqrt(k(a, a)[0] * k(b, b)[0]))
    assert similar("idiot", "idiot") == pytest.approx(1)
    assert similar("idiot", "idxiot") > 0.55 > similar("idiot", "then")


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    found = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert right > 0.94 and sum(found) / len(found) > 0.75


def test_inserted_letters_leave_insults_toxic(spark):
    insults = ["trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"]
    pick = random.Random(4)
    plain = ["".join(pick.choice("abdefghklnuv") for _ in range(pick.randrange(2, 9))) for _ in range(300)]

    def text(*more):
        return " ".join([*pick.choices(plain, k=40), *more])
    train = [(k, text(*([insults[k % 10]] * (k % 2 or k % 4 == 0))), int(k % 2 or k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    machine = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
    assert set(insults) <= set(machine.landmarks)
    made = []
    for word in insults:
        for letter in "xqe":
            made += [letter.join(word), *(word[:k] + letter + word[k:] for k in range(1, len(word)))]
            made += [word[:i] + letter + word[i:j] + letter + word[j:] for i in range(1, len(word)) for j in range(i + 1, len(word))]
    rows = [(k, text(word)) for k, word in enumerate(made)] + [(-1 - k, text()) for k in range(100)]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), machine).collect()}
    assert [made[k] for k in range(len(made)) if scores[k] < 0.5] == []
    assert max(scores[-1 - k] for k in range(100)) < 0.5


def test_one_insult_decides_and_words_that_contain_one_do_not(spark):
    """Trained as the query is: an insult at the end of a clean text, and plain words that hold its letters."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    machine = toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"),
                             F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    clean = [r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").filter("length(text) < 3000")
             .orderBy("doc_id").limit(30).select("text").collect()]
    insults = ["trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"]
    longer = ["closer", "clownfish", "scrumptious", "trashcan", "idiotic", "sympathetic", "stupor", "tomorrow"]
    rows = [(w, f"{text} {w}") for w in insults + longer for text in clean]
    scored = toxicity.score(spark.createDataFrame(rows, "doc_id string, text string").repartition(8), machine)
    share = {r.doc_id: r.share for r in scored.groupBy("doc_id").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("share")).collect()}
    assert min(share[w] for w in insults) >= 0.8, share
    assert max(share[w] for w in longer) <= 0.1, share


def test_similarity_against_a_plain_version():
    """Share of the landmark's kernel, gaps and edges, one pair of words at a time."""
    from itertools import combinations

    def parts(word):
        out = {}
        for i, j, k in combinations(range(len(word)), 3):
            out.setdefault(word[i] + word[j] + word[k], []).append((i, k))
        return out

    def plain(word, mark):
        own, has = parts(mark), parts(word)
        weight = {u: sum(toxicity.DECAY ** (k - i + 1) for i, k in at) for u, at in own.items()}
        both = [u for u in own if u in has]
        if not both:
            return 0.0
        value = {u: sum(toxicity.DECAY ** (k - i + 1) for i, k in has[u]) for u in both}
        apart = sum(toxicity.DECAY ** (2 * (k - i + 1) - 1) * weight[u] for u, at in own.items() for i, k in at)
        share = sum(weight[u] ** 2 for u in both) / sum(w ** 2 for w in weight.values())
        kernel = sum(min(value[u], weight[u]) * weight[u] for u in both)
        edges = min(i for u in both for i, _ in has[u]) + len(word) - 1 - max(k for u in both for _, k in has[u])
        return (min(1, share * min(1, kernel / apart)) * toxicity.EDGE ** edges) ** toxicity.POWER

    marks = ["idiot", "loser", "disgusting", "banana"]
    words = [*marks, "closer", "idixot", "ixdxixoxt", "bananas", "anna", "abc", "then", "disgust", "looser"]
    got = toxicity.Similarity(marks).words(np.stack([toxicity.code_word(w) for w in words]))
    for w, row in zip(words, got):
        assert row == pytest.approx([plain(w, m) for m in marks], abs=1e-5)


PII = {
    "card": "4111 1111 1111 1111", "phone": "+1 (988) 555-2485", "ip": "42.144.35.254", "ssn": "123-45-6789",
    "email": "Bos.t42@mail.example.com", "date": "2021-02-28",
}


def test_pseudonyms_keep_format_and_link(spark):
    texts = [f"a {v} b {v}, c" for v in PII.values()] + list(PII.values())
    rows = pseudonyms.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string"), "k").collect()
    half = len(PII)
    for kind, value, r, alone in zip(PII, PII.values(), rows[:half], rows[half:]):
        made = alone["PII_text"]
        assert r["PII_text"] == f"a {made} b {made}, c" and made != value
        assert r["PII_found"][kind] == 2 and sum(r["PII_found"]) == 2
        if kind != "ip":
            assert [c if not c.isalnum() else "9" for c in made] == [c if not c.isalnum() else "9" for c in value]
    assert rows[0]["PII_text"] != pseudonyms.pseudonymise(spark.createDataFrame([(texts[0],)], "text string"), "other").first()["PII_text"]


def test_pseudonyms_are_a_permutation(spark):
    days = spark.range(4000).select(F.date_format(F.date_add(F.lit("1990-01-01"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    made = pseudonyms.pseudonymise(days, "k")
    assert made.select("PII_text").distinct().count() == 4000
    assert made.filter("try_to_timestamp(PII_text, 'yyyy-MM-dd') is null").count() == 0
    cards = spark.range(500).select(F.concat(F.lit("4000"), F.lpad("id", 8, "0")).alias("b")).selectExpr(
        "concat(b, element_at(filter(sequence(0, 9), d -> luhn_check(concat(b, d))), 1)) AS text")
    made = pseudonyms.pseudonymise(cards, "k")
    assert made.filter("luhn_check(PII_text)").select("PII_text").distinct().count() == 500


def test_invalid_values_stay(spark):
    text = "4111111111111112 256.1.1.1 2021-02-30 000-12-3456 version 4.0. x203-456-7890"
    assert pseudonyms.pseudonymise(spark.createDataFrame([(text,)], "text string"), "k").first()["PII_text"] == text


def test_a_table_of_pieces_holds_many_in_little_room():
    """Random words recur; each is encoded once, as all of them fit into what a process may hold."""
    import public_tokenizers
    import pyarrow as pa

    from inferlake.llm import wordbpe
    from inferlake.llm.queries_tokens import TOKENIZER
    from inferlake.llm.words import slices

    path = public_tokenizers.path(TOKENIZER)
    made, asked = wordbpe.WordEncoder(path), []
    real = made._piece
    made._piece = lambda piece, kind: asked.append(piece) or real(piece, kind)
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghij"))
    texts = [" ".join("".join(w) for w in letters[rng.integers(0, 10, (40_000, 6))]) for _ in range(5)]
    texts += ["", "It's <|endoftext|> 12 É  x", None]
    got = []
    for _ in range(2):
        for part in slices(pa.array(texts)):
            flat, counts = made.encode(part, 1)
            got += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == 2 * [[*made.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert len(asked) == len(set(asked)) > 150_000 and made.held < wordbpe.HELD_BYTES
