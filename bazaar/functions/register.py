"""The library's functions by their names: as functions of a session's SQL, and on columns of DataFrames.

Functions of Columns are SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN``), which Spark puts in place of their
calls, so they stay in generated code; those in Python are UDFs. Both forms say the same (tested).
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from bazaar.functions import money, text
from bazaar.functions.phash import FAR, hamming, phash
from bazaar.functions.similarity import token_set_ratio
from bazaar.functions.text import nfkc
from bazaar.schema import NO_TITLE

UDFS = {"nfkc": nfkc, "token_set_ratio": token_set_ratio, "phash": phash}
COLUMNS = {
    "normalize_phone": text.normalize_phone, "normalize_text": text.normalize_text, "extract_phones": text.extract_phones, "extract_usernames": text.extract_usernames, "extract_contacts": text.extract_contacts,
    "title_of": text.title_of, "title_fallback": text.title_fallback, "has_arabic": text.has_arabic, "escape_html": text.escape_html,
    "parse_price": money.parse_price, "price_bucket": money.price_bucket, "format_price": money.format_price, "hash_distance": hamming,
}


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _once(value: str, name: str, body: str) -> str:
    """body, in which name is value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _ascii(x: str) -> str:
    return f"translate({x}, {_lit(text._ARABIC)}, '01234567890123456789')"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, {_lit(rf'(?U)^{text._S}+|{text._S}+\z')}, '')"


def _phone(x: str) -> str:
    code, rest = _lit("+" + text.COUNTRY), "ltrim('0', substring(d, 4))"
    cases = f"""CASE WHEN startswith(d, {_lit(text.COUNTRY)}) AND length({rest}) = 9 AND startswith({rest}, '5') THEN concat({code}, {rest})
        WHEN length(d) = 10 AND startswith(d, '05') THEN concat({code}, substring(d, 2, 9))
        WHEN length(d) = 9 AND startswith(d, '5') THEN concat({code}, d)
        WHEN length(d) BETWEEN 10 AND 15 THEN concat('+', d) END"""
    return _once(f"regexp_replace(regexp_replace({_ascii(x)}, {_lit(r'(?U)\D')}, ''), '^00', '')", "d", cases)


def _normalized(x: str) -> str:
    x = _ascii(f"nfkc({x})")
    for pattern, signs in text._SIGNS:
        cut = lambda v: f"regexp_replace({v}, {_lit(pattern)}, ' ')"  # noqa: B023, E731
        x = _once(x, "v", f"CASE WHEN {' OR '.join(f'contains(v, {_lit(s)})' for s in signs)} THEN {cut('v')} ELSE v END") if signs else cut(x)
    x = f"translate(lower(regexp_replace({x}, {_lit(r'[\p{So}\p{Sk}\p{Cf}\p{Cs}]')}, '')), 'ё', 'е')"
    x = f"regexp_replace({x}, {_lit(r'(?U)[^\p{L}\p{N}_\s\x1c-\x1f]')}, ' ')"
    return f"trim(regexp_replace({x}, {_lit(f'(?U){text._S}+')}, ' '))"


def _price(x: str) -> str:
    part = lambda i: f"regexp_extract(p, {_lit(money.PRICE)}, {i})"
    dots = "CASE WHEN length(n) - length(translate(n, '.', '')) > 1 THEN translate(n, '.', '') ELSE n END"
    number = _once(_once(f"rtrim('.', translate({part(1)}, ' ,', ''))", "n", dots), "n", "CASE WHEN n RLIKE '^[0-9]*[.]?[0-9]*$' THEN try_cast(n AS DOUBLE) END")
    code = " ".join(f"WHEN startswith(t, {_lit(word)}) THEN {_lit(name)}" for word, name in money.CURRENCIES.items())
    found = f"named_struct('amount', {number}, 'currency', {_once(f'lower({part(2)})', 't', f"CASE {code} ELSE 'SAR' END")})"
    return _once(_once(_ascii(x), "p", found), "f", "CASE WHEN f.amount > 0 THEN f END")


def _bucket(x: str) -> str:
    step = money.STEP
    more = f"CASE WHEN s.v >= {step}D THEN named_struct('v', s.v / {step}D, 'n', s.n + 1) ELSE s END"
    n = f"aggregate(sequence(1, CAST(ceil(ln(greatest({x}, 1D)) / ln({step}D)) + 2 AS INT)), named_struct('v', {x}, 'n', 0), (s, i) -> {more}, s -> s.n)"
    return f"CASE WHEN {x} > 0 THEN concat('b', CAST(floor({n} / 3) AS STRING)) ELSE 'na' END"


def _title(x: str) -> str:
    head = _strip(f"split_part(split_part(t, {_lit('،')}, 1), ',', 1)")
    cut = f"CASE WHEN contains(t, {_lit('،')}) OR length(t) > 70 THEN {head} ELSE t END"
    return f"coalesce(nullif(substring({_once(_strip(f"coalesce({x}, '')"), 't', cut)}, 1, 120), ''), {_lit(NO_TITLE)})"


def _escaped(x: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = f"replace({x}, {_lit(char)}, {_lit(name)})"
    return x


def _bits(x: str) -> str:
    return f"CASE WHEN {x} RLIKE '^[0-9a-fA-F]{{1,16}}$' THEN CAST(conv({x}, 16, -10) AS BIGINT) END"


_HANDLES = f"transform(regexp_extract_all(coalesce(x, ''), {_lit(text.HANDLE)}, 1), v -> lower(v))"
_LINES = f"filter(transform(split(coalesce(x, ''), {_lit(r'\R')}), v -> {_strip('v')}), v -> v <> '')"
_OF = lambda kind: f"v -> named_struct('type', '{kind}', 'value', v)"
_CONTACT = "STRUCT<type: STRING, value: STRING>"

#: Arguments, result and body of each SQL function; one may call those above it.
SQL = {
    "normalize_phone": ("x STRING", "STRING", _phone("x")),
    "extract_phones": ("x STRING", "ARRAY<STRING>", f"array_distinct(filter(transform(regexp_extract_all({_ascii("coalesce(x, '')")}, {_lit(f'({text.PHONE})')}, 1), v -> {_phone('v')}), v -> v IS NOT NULL))"),
    "extract_usernames": ("x STRING", "ARRAY<STRING>", f"array_distinct(filter({_HANDLES}, v -> v NOT IN ({', '.join(map(_lit, text.NO_HANDLES))})))"),
    "extract_contacts": ("x STRING", f"ARRAY<{_CONTACT}>", f"concat(transform(extract_phones(x), {_OF('phone')}), transform(extract_usernames(x), {_OF('telegram')}))"),
    "normalize_text": ("x STRING", "STRING", _normalized("x")),
    "title_of": ("x STRING", "STRING", _title("x")),
    "title_fallback": ("x STRING", "STRING", f"coalesce(substring(try_element_at({_LINES}, 1), 1, 120), {_lit(NO_TITLE)})"),
    "has_arabic": ("x STRING", "BOOLEAN", f"x RLIKE {_lit(r'[\x{0600}-\x{06FF}]')}"),
    "escape_html": ("x STRING", "STRING", _escaped("x")),
    "parse_price": ("x STRING", "STRUCT<amount: DOUBLE, currency: STRING>", _price("x")),
    "price_bucket": ("x DOUBLE", "STRING", _bucket("x")),
    "format_price": ("x DOUBLE, currency STRING, period STRING", "STRING", "CASE WHEN x <> 0 THEN concat_ws(' ', translate(format_number(x, 0), ',', ' '), currency, CASE WHEN period <> '' THEN concat('/ ', period) END) END"),
    "hash_distance": ("x STRING, y STRING", "INT", f"coalesce(bit_count({_bits('x')} ^ {_bits('y')}), {FAR})"),
}
#: Table functions, for LATERAL joins.
TABLES = {"contacts_of": ("x STRING", "type STRING, value STRING", "SELECT c.type, c.value FROM (SELECT extract_contacts(x) AS k) AS s LATERAL VIEW explode(s.k) e AS c")}


def apply_function(name: str, *args: Column | str) -> Column:
    """A function by its name, over columns."""
    if name in UDFS:
        return UDFS[name](*args)
    return COLUMNS[name](*(F.col(a) if isinstance(a, str) else a for a in args))


def register(spark: SparkSession) -> None:
    """All of them as temporary functions of the session, and ``contacts_of``, a row for each contact of a text."""
    for name, fn in UDFS.items():
        spark.udf.register(name, fn)
    for name, (args, kind, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, (args, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({columns}) RETURN {body}")
