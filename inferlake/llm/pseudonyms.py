r"""Format-preserving pseudonyms for personal numbers and dates, in SQL functions alone.

Found and validated: e-mail addresses, IPv4 addresses, calendar dates from 1900 to 2099
(yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy, also without leading zeros), social security numbers, phone
numbers, and card numbers with a right check digit. Each is replaced by another valid value
of its format: a keyed Feistel network of ``ROUNDS`` rounds permutes the value's digits (letters of an
address's local part, bits of a date or IP address) within their alphabets, where the round
function is SHA-256 over key, kind, round and half. As that is a permutation under one key,
equal values get equal pseudonyms in all documents and different values different ones, with no
table of values and no shuffle.

Kept as they are: separators, an address's domain, a phone's country code, a card's first digit; a
card's check digit is made anew. First digits of a phone's area and exchange stay in 2 to 9 if
they were. Dates and social security numbers are permuted again until they are valid
(cycle walking, at most ``WALKS`` steps: a date needs more with a probability under 1e-20).

Defined results: a null text stays null, an empty one empty; what isn't valid stays as it is;
equal rows get equal results; an empty table gives an empty result. Extra columns are kept, whatever their
names; the operator's own are ``PII_found`` (values replaced, by kind) and ``PII_text``, which replace input
columns of these names. A key that is null fails the query.

The key reaches the tasks as a column that a one-row table gives; it is no part of the plan, so neither
``explain()`` nor the event log shows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_name

ROUNDS = 8
WALKS = 64
FIRST_DAY, DAYS = "1900-01-01", 73049

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_BEFORE, _AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}+",
    "ip": _BEFORE + rf"(?:{_OCTET}[.]){{3}}{_OCTET}(?![0-9A-Za-z_]|[.][0-9])",
    "iso_date": _BEFORE + r"[0-9]{4}-[0-9]{2}-[0-9]{2}" + _AFTER,
    "date": _BEFORE + r"[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4}" + _AFTER,
    "ssn": _BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _AFTER,
    "phone": r"(?<![0-9A-Za-z_+])(?:[+][0-9]{1,3}[ .-]?)?(?:[(][0-9]{3}[)] ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}" + _AFTER,
    "card": _BEFORE + r"[0-9](?:[ -]?[0-9]){12,18}" + _AFTER,
}
KINDS = ("email", "ip", "date", "ssn", "phone", "card")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quoted(pattern: str) -> str:
    """A pattern (without quotes) as an SQL string."""
    return f"r'{pattern}'"


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _shifted(text: str, hashed: str, alphabets: tuple[str, ...]) -> str:
    """Each letter moved on within its alphabet by a number from the hash."""
    cases = " ".join(
        f"WHEN locate(c, '{a}') > 0 THEN substr('{a}', 1 + (locate(c, '{a}') - 1 + "
        f"cast(conv(substr({hashed}, 1 + 3 * (j % 20), 4), 16, 10) AS int)) % {len(a)}, 1)" for a in alphabets)
    return (f"CASE WHEN length({text}) = 0 THEN '' ELSE "
            f"array_join(transform(split({text}, ''), (c, j) -> CASE {cases} ELSE c END), '') END")


def feistel(text: str, kind: str, key: str, alphabets: tuple[str, ...] = (DIGITS,)) -> str:
    """SQL of a keyed permutation of strings with the same length and alphabets at each place."""
    half = _bind(f"sha2(concat({key}, ':{kind}:', i, ':', t.b), 256)", "h", _shifted("t.a", "h", alphabets))
    return _bind(text, "s", (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', substr(s, 1, length(s) div 2), "
        f"'b', substr(s, 1 + length(s) div 2)), (t, i) -> named_struct('a', t.b, 'b', {half}), t -> concat(t.a, t.b))"))


def _walk(value: str, step, valid) -> str:
    """Steps from ``value`` to the first valid one."""
    return f"aggregate(sequence(1, {WALKS}), {step(value)}, (v, n) -> CASE WHEN {valid('v')} THEN v ELSE {step('v')} END)"


def _refilled(match: str, digits: str) -> str:
    """A match with its digits replaced in order."""
    return (f"aggregate(split({match}, ''), named_struct('k', 1, 'o', ''), (t, c) -> CASE WHEN locate(c, '{DIGITS}') > 0 AND c <> '' "
            f"THEN named_struct('k', t.k + 1, 'o', concat(t.o, substr({digits}, t.k, 1))) "
            "ELSE named_struct('k', t.k, 'o', concat(t.o, c)) END, t -> t.o)")


def _date(match: str, pattern: str, key: str) -> str:
    day = f"datediff(to_date(d), date'{FIRST_DAY}')"
    bits = f"lpad(conv({day}, 10, 2), 17, '0')"
    walked = _walk(bits, lambda v: feistel(v, "date", key, ("01",)), lambda v: f"cast(conv({v}, 2, 10) AS int) < {DAYS}")
    made = f"date_format(date_add(date'{FIRST_DAY}', cast(conv({walked}, 2, 10) AS int)), {pattern})"
    return _bind(f"cast(try_to_timestamp({match}, {pattern}) AS date)", "d",
                 f"CASE WHEN {day} BETWEEN 0 AND {DAYS - 1} THEN {made} END")


def pseudonym(match: str, key: str) -> str:
    """SQL of (kind, pseudonym) for a match; the pseudonym is null where the match isn't valid."""
    digits = f"regexp_replace({match}, '[^0-9]', '')"
    is_kind = {k: f"{match} rlike {_quoted('^(?:' + p + ')$')}" for k, p in PATTERNS.items()}
    email = f"concat({feistel(f'''substring_index({match}, '@', 1)''', 'email', key, (DIGITS, LOWER, UPPER))}, '@', substring_index({match}, '@', -1))"
    octets = f"transform(split({match}, '[.]'), o -> lpad(lower(hex(cast(o AS int))), 2, '0'))"
    ip = _bind(feistel(f"array_join({octets}, '')", "ip", key, (DIGITS + "abcdef",)), "x",
               "array_join(transform(sequence(0, 3), k -> conv(substr(x, 1 + 2 * k, 2), 16, 10)), '.')")
    short = f"length({match}) < 10"
    sign = f"substr(regexp_replace({match}, '[0-9]', ''), 1, 1)"
    date = _date(match, f"CASE WHEN {short} THEN concat('d', {sign}, 'M', {sign}, 'yyyy') ELSE concat('dd', {sign}, 'MM', {sign}, 'yyyy') END", key)
    ssn_valid = r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"
    ssn = (f"CASE WHEN {digits} rlike '{ssn_valid}' THEN " + _bind(
        _walk(digits, lambda v: feistel(v, "ssn", key), lambda v: f"{v} rlike '{ssn_valid}'"), "x", _refilled(match, "x")) + " END")
    # The last ten digits; a first digit of 2 to 9 has an alphabet of its own, so that it stays one.
    leading = lambda at: f"CASE WHEN substr(n, {at}, 1) < '2' THEN translate(substr(n, {at}, 1), '01', 'yz') ELSE translate(substr(n, {at}, 1), '23456789', 'abcdefgh') END"
    spelled = f"concat({leading(1)}, substr(n, 2, 2), {leading(4)}, substr(n, 5))"
    national = _bind(f"right({digits}, 10)", "n", f"translate({feistel(spelled, 'phone', key, (DIGITS, 'abcdefgh', 'yz'))}, 'yzabcdefgh', '0123456789')")
    phone = _bind(f"concat(substr({digits}, 1, length({digits}) - 10), {national})", "x", _refilled(match, "x"))
    body = f"concat(substr({digits}, 1, 1), {feistel(f'substr({digits}, 2, length({digits}) - 2)', 'card', key)})"
    card = (f"CASE WHEN luhn_check({digits}) THEN " + _bind(
        _bind(body, "b", "concat(b, element_at(filter(sequence(0, 9), d -> luhn_check(concat(b, d))), 1))"), "x", _refilled(match, "x")) + " END")
    iso = _date(match, "'yyyy-MM-dd'", key)
    made = {"email": ("email", email), "ip": ("ip", ip), "iso_date": ("date", iso), "date": ("date", date),
            "ssn": ("ssn", ssn), "phone": ("phone", phone), "card": ("card", card)}
    cases = " ".join(f"WHEN {is_kind[k]} THEN named_struct('kind', '{name}', 'made', {sql})" for k, (name, sql) in made.items())
    return f"CASE {cases} END"


def pseudonymise(docs: DataFrame, key: str | DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``PII_text`` and ``PII_found`` (a struct with a count for each kind).

    ``key`` is the secret itself, or a table with one row and one column that holds it.
    """
    secret = key if isinstance(key, DataFrame) else docs.sparkSession.createDataFrame([(key,)], "key string")
    key_at, matches, made = (free_name(docs, name) for name in ("PII_key", "PII_matches", "PII_made"))
    column = "`" + text.replace("`", "``") + "`"
    pattern = _quoted("|".join(f"(?:{p})" for p in PATTERNS.values()))
    found = docs.withColumns({
        key_at: F.coalesce(secret.scalar(), F.raise_error(F.lit("no key for the pseudonyms"))),
        matches: F.expr(
            f"CASE WHEN {column} rlike '[0-9@]' THEN regexp_extract_all({column}, {pattern}, 0) ELSE array() END")})
    result = "named_struct('kind', p.kind, 'to', coalesce(p.made, m), 'valid', p.made IS NOT NULL)"
    filled = found.withColumn(made, F.expr(f"transform({matches}, m -> {_bind(pseudonym('m', key_at), 'p', result)})"))
    # The text between matches, one piece more than there are matches.
    joined = (f"array_join(flatten(zip_with(split({column}, {pattern}, -1), {made}, "
              "(p, m) -> array(p, coalesce(m.to, '')))), '')")
    counts = F.struct(*(F.expr(f"cast(size(filter({made}, m -> m.valid AND m.kind = '{k}')) AS long)").alias(k) for k in KINDS))
    return filled.withColumns({
        "PII_text": F.expr(f"CASE WHEN size({matches}) > 0 THEN {joined} ELSE {column} END"),
        "PII_found": counts,
    }).drop(key_at, matches, made)


def found_in_total(found: str | Column = "PII_found") -> Column:
    return sum((F.col(f"{found}.{k}") for k in KINDS[1:]), F.col(f"{found}.{KINDS[0]}"))
