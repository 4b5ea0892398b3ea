"""Text, phones and contacts as Column functions.

Words are letters, numbers and the underscore of any script; white space is Unicode's with 1C to 1F.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bazaar.schema import NO_TITLE

_W, _S = r"[\p{L}\p{N}_]", r"[\s\x1c-\x1f]"
_START, _END = rf"(?<!{_W})", rf"(?!{_W})"
_ARABIC = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"

# The spellings of phones and handles, and what is cut from texts before they are compared.
COUNTRY = "966"
PHONE = rf"(?U)(?:\+|00)\d[\d\s\x1c-\x1f()\-.]{{6,}}\d|{_START}966[\d\s\x1c-\x1f()\-.]{{7,}}\d|{_START}0?5[\d\s\x1c-\x1f()\-.]{{7,}}\d"
HANDLE = rf"(?:@|(?:https?://)?t\.me/)([A-Za-z][A-Za-z0-9_]{{3,31}}){_END}"
NO_HANDLES = ["joinchat", "share", "addstickers", "proxy", "iv"]
URL = r"(?U)https?://[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+"
HASHTAG = rf"#{_W}+"
FOOTER = rf"(?imuUd)^{_S}*(?:подпис{_W}*|наш{_S}+канал|канал{_S}*:|реклам{_W}*|сотрудничеств{_W}*|по{_S}+вопросам{_S}+рекламы|прислать{_S}+объявлен{_W}*|бот{_S}+для{_S}+объявлен{_W}*|subscribe|join{_S}+us)(?:(?<={_W}){_END}|(?<!{_W})(?={_W})).*$"
LABEL = rf"(?iuU)(?=[тнзпсквwptcm]){_START}(?:тел(?:ефон)?|номер|звонить|звоните|писать|пишите|связь|контакт{_W}*|whats?app|ватсап|вотсап|вацап|phone|tel|contact|call|mob(?:ile)?){_END}"
# Cities and what names them in a title; what opens an item of an enumeration.
CITIES = {"Мекка": "мекк", "Медина": "медин", "Джидда": "джидд", "Эр-Рияд": "эр-рияд|эррияд", "Даммам": "даммам", "Таиф": "таиф", "Янбу": "янбу", "Абха": "абха", "Аль-Ула": "аль-ул"}
ENUMERATION = r"(?U)^\s*(?:[•\-–—*]|\d+[.)])\s|maps\.app\.goo\.gl|goo\.gl/maps"
PIN, SOURCE = "📍", "Источник:"


def strip(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, rf"(?U)^{_S}+|{_S}+\z", "")


def clean(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def ascii_digits(x: Column) -> Column:
    return F.translate(x, _ARABIC, "01234567890123456789")


def digits(x: Column) -> Column:
    return F.regexp_replace(ascii_digits(x), r"(?U)\D", "")


def normalize_phone(x: Column) -> Column:
    """E.164, or null: local mobiles get the country code, other numbers of 10 to 15 digits stay."""
    d = F.regexp_replace(digits(x), "^00", "")
    rest = F.ltrim(F.substring(d, 4, 1 << 30), F.lit("0"))
    mobile = lambda v: (F.length(v) == 9) & v.startswith("5")
    return (
        F.when(d.startswith(COUNTRY) & mobile(rest), F.concat(F.lit("+" + COUNTRY), rest))
        .when((F.length(d) == 10) & d.startswith("05"), F.concat(F.lit("+" + COUNTRY), F.substring(d, 2, 9)))
        .when(mobile(d), F.concat(F.lit("+" + COUNTRY), d))
        .when(F.length(d).between(10, 15), F.concat(F.lit("+"), d))
    )


def _distinct(found: Column) -> Column:
    return F.array_distinct(F.filter(found, lambda v: v.isNotNull()))


def extract_phones(text: Column) -> Column:
    """Distinct phones in the order of the text; empty for null."""
    found = F.regexp_extract_all(ascii_digits(F.coalesce(text, F.lit(""))), F.lit(f"({PHONE})"), F.lit(1))
    return _distinct(F.transform(found, normalize_phone))


def extract_usernames(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HANDLE), F.lit(1)), F.lower)
    return _distinct(F.filter(found, lambda v: ~v.isin(NO_HANDLES)))


def extract_contacts(text: Column) -> Column:
    """Phones, then handles, as {type, value}."""
    of = lambda kind: lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    return F.concat(F.transform(extract_phones(text), of("phone")), F.transform(extract_usernames(text), of("telegram")))


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Spark has no compatibility normalisation; ASCII batches pass through."""
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def _without(x: Column, pattern: str, signs: list[str]) -> Column:
    """x with what the pattern matches as spaces. Texts without any of ``signs``, one of which each match has, are not
    searched, if there are signs: looking for fixed letters takes a fraction of the time."""
    if not signs:
        return F.regexp_replace(x, pattern, " ")

    def one(v: Column) -> Column:
        maybe = F.lit(False)
        for sign in signs:
            maybe = maybe | v.contains(sign)
        return F.when(maybe, F.regexp_replace(v, pattern, " ")).otherwise(v)

    return F.element_at(F.transform(F.array(x), one), 1)  # x is evaluated once


# What a match of each pattern has in it at least, where that can be looked for.
_SIGNS = [(FOOTER, []), (URL, ["http", "www."]), (HANDLE, ["@", "t.me/"]), (PHONE, ["+", "0", "5", "966"]), (HASHTAG, ["#"]), (LABEL, [])]


def normalize_text(text: Column, compose: bool = True) -> Column:
    """What is compared of a text: no links, contacts, labels, pictures or punctuation; small letters, single spaces.

    compose=False leaves out NFKC, and with it the only Python step.
    """
    x = ascii_digits(nfkc(text) if compose else text)
    for pattern, signs in _SIGNS:
        x = _without(x, pattern, signs)
    x = F.lower(F.regexp_replace(x, r"[\p{So}\p{Sk}\p{Cf}\p{Cs}]", ""))
    x = F.regexp_replace(F.translate(x, "ё", "е"), rf"(?U)[^\p{{L}}\p{{N}}_\s\x1c-\x1f]", " ")
    return F.trim(F.regexp_replace(x, rf"(?U){_S}+", " "))


def title_fallback(text: Column) -> Column:
    """The first line that isn't blank, 120 characters of it."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), strip), lambda v: v != "")
    return F.coalesce(F.substring(F.try_element_at(lines, F.lit(1)), 1, 120), F.lit(NO_TITLE))


def summary_fallback(text: Column) -> Column:
    return F.nullif(F.substring(strip(text), 1, 400), F.lit(""))


def title_of(raw: Column) -> Column:
    """A place's title: what stands before the comma where it is an address."""
    t = strip(F.coalesce(raw, F.lit("")))
    head = strip(F.split_part(F.split_part(t, F.lit("،"), F.lit(1)), F.lit(","), F.lit(1)))
    t = F.when(t.contains("،") | (F.length(t) > 70), head).otherwise(t)
    return F.coalesce(F.nullif(F.substring(t, 1, 120), F.lit("")), F.lit(NO_TITLE))


def summary_of(body: Column, shared: Column) -> Column:
    """A place's description: no service lines; of a post about several places, what comes before the first of them."""

    def step(s: Column, line: Column) -> Column:
        kept, open_ = s["kept"], ~s["stopped"]
        bare = strip(line)
        service = bare.startswith(PIN) | bare.startswith(SOURCE)
        item = line.rlike(ENUMERATION) | (line.contains(PIN) & (F.size(kept) > 0))
        stop = open_ & ~service & shared & item
        return F.struct(F.when(open_ & ~service & ~stop, F.concat(kept, F.array(line))).otherwise(kept).alias("kept"), (s["stopped"] | stop).alias("stopped"))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("stopped"))
    lines = F.split(strip(body), r"\R")
    return F.nullif(F.substring(strip(F.array_join(F.aggregate(lines, start, step, lambda s: s["kept"]), "\n")), 1, 1500), F.lit(""))


def city_of(city: Column, title: Column) -> Column:
    """The city given, else the one that the title names if it names just one."""
    low = F.lower(F.coalesce(title, F.lit("")))
    found = F.filter(F.array(*(F.when(low.rlike(p), F.lit(name)) for name, p in CITIES.items())), lambda v: v.isNotNull())
    return F.coalesce(clean(city), F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1))))


def has_arabic(text: Column) -> Column:
    return text.rlike(r"[\x{0600}-\x{06FF}]")


def first_features(features: Column) -> Column:
    """The first four that aren't blank, stripped."""
    return F.slice(F.filter(F.transform(features, strip), lambda v: v != ""), 1, 4)


def without_empty(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))


def escape_html(x: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x
