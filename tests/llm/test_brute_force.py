"""Queries that SQL can't express against plain versions on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inferlake.llm import decontam, katz, queries_lm, queries_lpf, queries_lines, queries_quality, queries_tokens
from inferlake.llm.queries_lines import templates

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_repeats(spark, docs):
    seen = Counter()
    for text in docs.values():
        data = text.encode()
        seen.update(data[i:i + 200] for i in range(len(data) - 199))
    for r in queries_lpf.op5_lpf_dedup(spark, SF_DIR).collect():
        data = docs[r["doc_id"]].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 199):
            if seen[data[i:i + 200]] > 1:
                gone[i:i + 200] = b"\x01" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_tokens(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for r in sorted(queries_tokens.op6_huffman_tokens(spark, SF_DIR).collect(), key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 1]
        data = np.array(ids, "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(data))
        start += len(ids)


def test_base_quality(spark, docs):
    for r in queries_quality.op10_quality_rules(spark, SF_DIR).collect():
        text = docs[r["doc_id"]]
        found = [m.decode() for m in WORD.findall(text.encode())]
        windows = Counter(tuple(found[i:i + 5]) for i in range(len(found) - 4))
        repeated = {i + k for i in range(len(found) - 4) if windows[tuple(found[i:i + 5])] > 1 for k in range(5)}
        lines, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line.encode()):
                again += line in lines
                lines.add(line)
        failed = len(found) < 10 or 100 * len(repeated) > 20 * len(found)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), again, len(repeated), failed)
        assert not (failed and r["kept"])


def test_templates(spark, docs):
    lines = []
    for doc_id, text in docs.items():
        for line in text.encode().split(b"\n"):
            found = tuple(b"<*>" if re.search(rb"[0-9]", w) else w for w in WORD.findall(line.lower()))
            if found:
                lines.append((doc_id, (len(found), found[:2]), found))
    least = templates.MIN_DOCS
    leaves, tokens, made = defaultdict(set), defaultdict(set), defaultdict(set)
    for d, leaf, found in lines:
        leaves[leaf].add(d)
    for d, leaf, found in lines:
        for k, w in enumerate(found):
            tokens[leaf, k, w].add(d)
    named = []
    for d, leaf, found in lines:
        fixed = tuple(w if w != b"<*>" and len(tokens[leaf, k, w]) >= least else None for k, w in enumerate(found))
        specific = len(leaves[leaf]) >= least and sum(w is not None for w in fixed) >= templates.SPECIFIC * len(fixed)
        named.append((leaf, fixed) if specific else None)
        if specific:
            made[leaf, fixed].add(d)
    want, gone = Counter(d for d, *_ in lines), Counter()
    for (d, *_), name in zip(lines, named):
        gone[d] += name is not None and len(made[name]) >= least
    assert sum(gone.values()) > 0
    for r in queries_lines.op7_line_templates(spark, SF_DIR).collect():
        assert (r["n_lines"], r["n_dropped"]) == (want[r["doc_id"]], gone[r["doc_id"]])


def tokens_of(text):
    return [w.decode() for w in WORD.findall(text.encode().lower())] + ["</s>"]


class PlainKatz:
    """Dictionaries, recursion, and no hashing."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order)]
        self.contexts = [Counter() for _ in range(order)]
        for text in texts:
            found = tokens_of(text)
            for k in range(order):
                padded = ["<s>"] * k + found
                for i in range(k, len(padded)):
                    gram = tuple(padded[i - k:i + 1])
                    self.counts[k][gram] += 1
                    self.contexts[k][gram[:-1]] += 1
        self.discounts = []
        for counts in self.counts:
            of = np.bincount(np.minimum(list(counts.values()), katz.MAX_COUNT + 2), minlength=katz.MAX_COUNT + 3)[:katz.MAX_COUNT + 2]
            of[0] = 0
            self.discounts.append(katz.Discounts(of, sum(counts.values()), len(counts)))
        of = np.bincount(np.minimum(list(self.counts[0].values()), katz.MAX_COUNT + 2), minlength=katz.MAX_COUNT + 3)[:katz.MAX_COUNT + 2]
        of[0] = 0
        self.unigrams = katz.Unigrams(self.discounts[0], of)
        self.followers = [defaultdict(list) for _ in range(order)]
        for k, counts in enumerate(self.counts):
            for gram in counts:
                self.followers[k][gram[:-1]].append(gram[-1])

    def probability(self, gram):
        k = len(gram) - 1
        if k == 0:
            return float(self.unigrams.probability(np.array([self.counts[0][gram]]))[0])
        history, total = gram[:-1], self.contexts[k][gram[:-1]]
        if not total:
            return self.probability(gram[1:])
        kept = lambda w: float(self.discounts[k].kept(np.array([self.counts[k][(*history, w)]]))[0])
        lost = sum(self.counts[k][(*history, w)] - kept(w) for w in self.followers[k][history])
        raised = lost <= 1e-9
        if self.counts[k][gram]:
            return kept(gram[-1]) / (total + raised)
        left = (lost + raised) / (total + raised)
        seen = sum(self.probability((*history[1:], w)) for w in self.followers[k][history])
        return left / (1 - seen) * self.probability(gram[1:])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(spark, order):
    texts = {k: " ".join(f"v{(k * i * i + i) % (7 + k % 5)}" for i in range(25 + k)) for k in range(30)}
    texts |= {30: "", 31: "new words only", 32: None, 33: "v1 new v2"}
    training = [t or "" for k, t in texts.items() if k % 5 != 1]
    plain = PlainKatz(training, order)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    vocabulary = [g[0] for g in plain.counts[0]] + ["never seen"]
    for history in list(plain.contexts[order - 1])[:40]:
        assert math.isclose(sum(plain.probability((*history, w)) for w in vocabulary), 1, rel_tol=1e-9)
    for r in katz.katz_scores(table, table["doc_id"] % 5 == 1, order=order).collect():
        found = tokens_of(texts[r["doc_id"]] or "")
        padded = ["<s>"] * (order - 1) + found
        want = sum(math.log10(plain.probability(tuple(padded[i:i + order]))) for i in range(len(found)))
        assert math.isclose(r["score"], want, rel_tol=1e-9, abs_tol=1e-9)
        counts, n, v = plain.counts[0], sum(plain.counts[0].values()), len(plain.counts[0])
        base = sum(math.log10((counts[w,] + 0.5) / (n + 0.5 * (v + 1))) for w in found)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(found), sum(counts[w,] > 0 for w in found), n)


def test_model_beats_base_on_held_out(spark):
    held = [r for r in queries_lm.op1_katz_scores(spark, SF_DIR).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row)


def test_decontamination(spark, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    some = dict(list(docs.items())[:12])
    item = decontam.normal(items[0])
    edited = item[:40] + "x" + item[41:100] + item[103:]
    some[-1] = "before it " + edited.upper().replace(" ", "  \n") + " after"
    few = {k: items[k] for k in list(items)[:8]}
    want = {(d, i): distance(decontam.normal(t), decontam.normal(text)) for d, text in some.items() for i, t in few.items()
            if len(text) < 4000}
    want = {k: n for k, n in want.items() if n <= decontam.budget(len(decontam.normal(few[k[1]])))}
    assert want[-1, 0] == 4
    got = decontam.matches(spark.createDataFrame(list(some.items()), "doc_id long, text string"),
                           spark.createDataFrame(list(few.items()), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got if len(some[r["doc_id"]]) < 4000} == want
