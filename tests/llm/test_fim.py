"""Fill-in-middle outputs against a plain version, long and odd texts included."""

import hashlib
import re

import pytest
from edge_tables import edge, empty, rows

from inferlake.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(table):
    out = []
    for doc_id, text in table:
        *facts, output = plain(doc_id, text)
        out.append((*facts, sha(output), sha(text or "")))
    return sorted(out, key=str)


ODD = ["<", "a<P", "x <P> y", "<S>", ">< M>", "a\x1fb c", "é ü ß", " lead", "tail ", "\n\n", "a" * 5000, "ü" * 3000,
       "one two " * 4000, "<P", "S><", "\U0001f600 \U0001f600"]


@pytest.mark.parametrize("size", [1 << 18, 64, 5])
def test_outputs_and_restored_texts(spark, monkeypatch, size):
    monkeypatch.setattr(fim, "PIECE_BYTES", size)
    monkeypatch.setattr(fim, "PIECE_UNITS", max(2, size // 8))
    monkeypatch.setattr(fim, "BATCH_BYTES", 4 * size)
    table = [(r[0], r[1]) for r in rows()] + [(1000 + 100 * j + k, t) for j in range(4) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in fim.digests(df).collect()), key=str) == expected(table)


def test_output_files_hold_the_outputs(spark):
    table = [(k, t) for k, t in enumerate(ODD * 3)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    texts = {}
    for r in fim.outputs(fim.pieces(df), 3).collect():
        texts.setdefault((r.place, r.doc), []).append((r["at"], bytes(r.body)))
    got = {doc: b"".join(b for _, b in sorted(found)).decode() for (_, doc), found in texts.items()}
    assert got == {str(k): plain(k, t)[-1] for k, t in table}
    assert {plain(k, t)[2] for k, t in table} == {"plain", "psm", "spm"}


def test_edges_clashing_names_and_an_empty_table(spark):
    got = fim.digests(edge(spark)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected([(r[0], r[1]) for r in rows()])
    assert fim.digests(empty(spark)).count() == 0


def test_one_exchange(spark, plan_of):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = plan_of(fim.digests(df))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2


def test_string_ids(spark):
    df = spark.createDataFrame([("x y", "a b c"), ("", "a b c")], "doc_id string, text string")
    assert sorted((tuple(r) for r in fim.digests(df).collect()), key=str) == expected([("x y", "a b c"), ("", "a b c")])
