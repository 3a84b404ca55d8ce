"""Pseudonyms against a plain version; the key stays out of plans; clashing names."""

import datetime
import hashlib
import re

import pytest
from edge_tables import edge, rows
from pyspark.sql import functions as F

from inferlake.llm import mixing, pseudonyms, quality
from inferlake.llm.queries_pii import KEY, op2_pseudonyms

SF_DIR = "/root/testdata/sf0.001"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DAY0 = datetime.date(1900, 1, 1)
ANY = re.compile("|".join(f"(?:{p})" for p in pseudonyms.PATTERNS.values()), re.ASCII)


def permuted(text, kind, key, alphabets=(DIGITS,)):
    a, b = text[:len(text) // 2], text[len(text) // 2:]
    for i in range(1, pseudonyms.ROUNDS + 1):
        digest = hashlib.sha256(f"{key}:{kind}:{i}:{b}".encode()).hexdigest()
        moved = ""
        for j, c in enumerate(a):
            own = next((x for x in alphabets if c in x), None)
            step = int(digest[3 * (j % 20):3 * (j % 20) + 4], 16)
            moved += own[(own.index(c) + step) % len(own)] if own else c
        a, b = b, moved
    return a + b


def walked(value, step, valid):
    value = step(value)
    while not valid(value):
        value = step(value)
    return value


def refill(match, digits):
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in match)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def good_ssn(d):
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def new_date(year, month, day, key):
    try:
        days = (datetime.date(int(year), int(month), int(day)) - DAY0).days
    except ValueError:
        return None
    if not 0 <= days < pseudonyms.DAYS:
        return None
    bits = walked(format(days, "017b"), lambda v: permuted(v, "date", key, ("01",)), lambda v: int(v, 2) < pseudonyms.DAYS)
    return DAY0 + datetime.timedelta(int(bits, 2))


def plain(match, key):
    """(kind, pseudonym or None) of a match."""
    kind = next(k for k, p in pseudonyms.PATTERNS.items() if re.fullmatch(p, match, re.ASCII))
    digits = re.sub("[^0-9]", "", match)
    if kind == "email":
        local, domain = match.split("@")
        return kind, permuted(local, "email", key, (DIGITS, LOWER, UPPER)) + "@" + domain
    if kind == "ip":
        made = permuted("".join(f"{int(x):02x}" for x in match.split(".")), "ip", key, (DIGITS + "abcdef",))
        return kind, ".".join(str(int(made[k:k + 2], 16)) for k in range(0, 8, 2))
    if kind == "iso_date":
        d = new_date(*match.split("-"), key)
        return "date", d and f"{d:%Y-%m-%d}"
    if kind == "date":
        sign = re.sub("[0-9]", "", match)[0]
        d = new_date(*match.split(sign)[::-1], key) if len(match) < 10 or len(match.split(sign)[0]) == 2 else None
        if d is None:
            return kind, None
        return kind, f"{d.day}{sign}{d.month}{sign}{d.year}" if len(match) < 10 else f"{d.day:02}{sign}{d.month:02}{sign}{d.year}"
    if kind == "ssn":
        return kind, refill(match, walked(digits, lambda v: permuted(v, "ssn", key), good_ssn)) if good_ssn(digits) else None
    if kind == "phone":
        to, back = str.maketrans("0123456789", "yzabcdefgh"), str.maketrans("yzabcdefgh", "0123456789")
        n = digits[-10:]
        n = n[0].translate(to) + n[1:3] + n[3].translate(to) + n[4:]
        return kind, refill(match, digits[:-10] + permuted(n, "phone", key, (DIGITS, "abcdefgh", "yz")).translate(back))
    if not luhn(digits):
        return kind, None
    body = digits[0] + permuted(digits[1:-1], "card", key)
    return kind, refill(match, body + next(c for c in DIGITS if luhn(body + c)))


def replaced(text, key):
    counts = dict.fromkeys(pseudonyms.KINDS, 0)

    def one(match):
        kind, made = plain(match.group(0), key)
        counts[kind] += made is not None
        return match.group(0) if made is None else made
    return text and ANY.sub(one, text), counts


def test_query_against_a_plain_version(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = 0
    for r in op2_pseudonyms(spark, SF_DIR).collect():
        text, counts = replaced(docs[r["doc_id"]], KEY)
        assert (r["text"], r["n_values"]) == (text, sum(counts.values()))
        assert {k: r[f"n_{k}"] for k in counts} == counts
        found += r["n_values"]
    assert found > 20


@pytest.mark.parametrize("key", ["k", "it's \\ \"quoted\"", "é{}`$"])
def test_made_values_against_a_plain_version(spark, key):
    texts = ["x.y-9Z@mail.example.org, 1/2/2003; 31.12.1999 30.02.2000", "2020-02-29 1899-12-31 2099-12-31 1900-01-01",
             "+44 (020) 123-4567 203 456 7890", "123-45-6789 666-12-3456 10.0.0.255", "4111-1111-1111-1111 4111 1111 1111 1112",
             None, "", "a@b.co@c.de", "5500005555555559 9/9/1999"]
    got = pseudonyms.pseudonymise(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string"), key).collect()
    for r in got:
        text, counts = replaced(r["text"], key)
        assert r["PII_text"] == text and (not text or r["PII_found"].asDict() == counts)


def test_key_is_not_in_the_plan(spark):
    docs = spark.createDataFrame([("call 203-456-7890",)], "text string")
    for key in ("s3cret-key", spark.createDataFrame([("s3cret-key",)], "k string")):
        made = pseudonyms.pseudonymise(docs, key)
        text = made.first()["PII_text"]
        assert text == replaced("call 203-456-7890", "s3cret-key")[0]
        assert "s3cret" not in made._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="no key"):
        pseudonyms.pseudonymise(docs, spark.createDataFrame([(None,)], "k string")).collect()


def test_input_columns_of_the_operators_names_stay(spark):
    docs = edge(spark)
    internal = ["PII_key", "PII_matches", "pii_made", "QR_lang", "QR_text", "QR_name", "QR_classes", "QR_total", "QR_ranked",
                "MIX_source", "MIX_place", "MIX_cut", "mix_extra", "MIX_copy"]
    added = ["PII_text", "QR_words", "QR_kept", "MIX_size", "MIX_target"]
    wide = docs.withColumns({c: F.lit(c) for c in internal + added})
    for out, own in ((pseudonyms.pseudonymise(wide, "k"), "PII_"), (quality.quality(wide), "QR_"), (mixing.mixing_plan(wide), "MIX_")):
        got = out.collect()
        assert len(got) == len(rows()) and len(set(map(str.lower, out.columns))) == len(out.columns)
        for c in internal + [x for x in added if not x.startswith(own)]:
            assert {r[c] for r in got} == {c}
    of = {k: out.select("doc_id", k).collect() for k, out in (("QR_words", quality.quality(wide)), ("MIX_size", mixing.mixing_plan(wide)))}
    assert all(isinstance(r[1], int) for rows_ in of.values() for r in rows_)
    mixed = mixing.mix(wide)
    assert mixed.columns == wide.columns
    assert {tuple(r[c] for c in internal + added) for r in mixed.collect()} == {tuple(internal + added)}
