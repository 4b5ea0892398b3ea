"""Format-preserving pseudonyms of personal data, in DataFrame functions only.

What matches a kind's pattern and passes its validation is permuted within the values of its format by a keyed
Feistel network, so equal values get equal pseudonyms in every document, different ones different pseudonyms.

Numbers have a domain of a * b values, split as (l, r) with l < a and r < b. Rounds add a keyed hash of one half to
the other, modulo a or b in turn: a permutation of the whole domain, without walking (but for dates, see below).

Kinds (what is replaced; what stays):
  card    13 to 19 digits with a right Luhn digit, also in groups of four, or of 4, 6 and 5 (first digit and separators
          stay; the last digit is made right again)
  phone   North American numbers, area and exchange from 200 (+1, brackets and separators stay); numbers of other
          countries with + and 8 to 15 digits (country code, next digit, brackets and separators stay)
  ssn     ddd-dd-dddd with no part 0, area not 666 or 900 and over (permuted among such)
  ip      dotted quads of 0 to 255
  date    real days of 1900 to 2099, yyyy-mm-dd or dd-mm-yyyy with -, / or . (permuted among those days)
  email   letters and digits of the local part, each within its class (other characters and the domain stay; of letters
          beyond ASCII those of Latin-1, in four classes)
  secret  AKIA keys, and values of 8 and more characters, however long, after password=, Token = " and the like, up to the
          quote or else to white space: as email. A name before it makes a secret of an address, too
Not looked for: phone numbers of ten digits in a row, IPv6.
Numbers that fail validation, and all other text, stay as they are; but a secret that looks like a number of another
kind and fails that kind's validation is a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import free

ROUNDS = 8
#: Halves of secrets longer than this are hashed through their digest, so long ones take linear time.
LONG = 64
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: What comes before a secret.
_NAME = r"(?i:password|passwd|secret|token|api_key) ?[=:] ?"
NAMED = rf"(?:{_NAME}[\"']?)"
#: What begins a country's code of one digit, of two; others have three.
_CODE1, _CODE2 = "^[17]", "^(?:20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Each pattern begins where a run of its characters begins, so a long run is tried once, not from every place.
PATTERNS = {
    # in quotes up to the quote, else up to white space, without the punctuation at the end
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=" + _NAME + r"\")[^\"\n\r]{8,}+(?=\")|(?<=" + _NAME + r"')[^'\n\r]{8,}+(?=')|(?<=" + NAMED + r")(?![\"'])(?=\S{8})\S*[\p{L}\p{N}_/+-]",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"(?<![A-Za-z0-9+])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?[2-9]\d\d[ .-]?|[2-9]\d\d[ .-][2-9]\d\d[ .-])\d{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9+])\+(?!1)\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?![A-Za-z0-9])",
    "ip": rf"(?<![A-Za-z0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![A-Za-z0-9-])",
    "date": "",  # below
    "card": r"(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,4}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])",
}
_ISO = "|".join(rf"{_YEAR}{s}{_MONTH}{s}{_DAY}" for s in ("-", "/", r"\."))
_EURO = "|".join(rf"{_DAY}{s}{_MONTH}{s}{_YEAR}" for s in ("-", "/", r"\."))
PATTERNS["date"] = rf"(?<![A-Za-z0-9./-])(?:{_ISO}|{_EURO})(?![A-Za-z0-9/-]|\.\d)"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

_FIRST, _LAST = "1900-01-01", "2099-12-31"
_DAYS = 73049


def _hash(key: str, *parts: Column | str) -> Column:
    """60 bits of SHA-256 over the key and parts."""
    text = F.concat_ws("|", F.lit(key), *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permute(value: Column, a: Column | int, b: Column | int, key: str, kind: Column | str) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["l"] + _hash(key, kind, i, s["r"]), a).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + _hash(key, kind, i, s["l"]), b).alias("r"))
        return F.when(i % 2 == 1, left).otherwise(right)

    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])


def _ten(k: Column) -> Column:
    return F.rpad(F.lit("1"), k + 1, "0").cast("long")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _put(mask: Column, digits: Column) -> Column:
    """digits in the places of mask's digits."""
    kept = F.split(mask, "[0-9]", -1)
    return F.concat_ws("", F.flatten(F.zip_with(kept, F.split(digits, ""), lambda x, y: F.array(x, F.coalesce(y, F.lit(""))))))


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits, where every second one from the right is doubled, the last too if doubled is 1."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((i + doubled) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _card(text: Column, key: str) -> Column:
    digits = _digits(text)
    n = F.length(digits) - 2  # between the first and the check digit
    half = F.floor(n / 2).cast("int")
    value = F.substring(digits, F.lit(2), n).cast("long")
    inner = F.lpad(permute(value, _ten(half), _ten(n - half), key, "card").cast("string"), n, "0")
    body = F.concat(F.substring(digits, 1, 1), inner)
    check = F.pmod(10 - F.pmod(_luhn_sum(body, 1), F.lit(10)), F.lit(10))
    good = F.length(digits).between(13, 19) & (F.pmod(_luhn_sum(digits, 0), F.lit(10)) == 0)
    return F.when(good, _put(text, F.concat(body, check.cast("string"))))


def _phone(text: Column, key: str) -> Column:
    digits = _digits(text)
    own = F.right(digits, F.lit(10))
    area, exchange, line = (F.substring(own, p, k).cast("long") - low for p, k, low in ((1, 3, 200), (4, 3, 200), (7, 4, 0)))
    v = permute((area * 800 + exchange) * 10000 + line, 800, 8_000_000, key, "phone")
    new = F.concat((F.floor(v / 8_000_000) + 200).cast("string"), (F.pmod(F.floor(v / 10000), F.lit(800)) + 200).cast("string"), F.lpad(F.pmod(v, F.lit(10000)).cast("string"), 4, "0"))
    american = _put(text, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), new))
    head = F.substring(digits, F.lit(1), F.when(digits.rlike(_CODE1), 2).when(digits.rlike(_CODE2), 3).otherwise(4))
    n = F.length(digits) - F.length(head)
    half = F.floor(n / 2).cast("int")
    w = permute(F.substring(digits, F.length(head) + 1, n).cast("long"), _ten(half), _ten(n - half), key, F.concat(F.lit("phone+"), head))
    abroad = F.when(F.length(digits).between(8, 15), _put(text, F.concat(head, F.lpad(w.cast("string"), n, "0"))))
    return F.when(text.rlike(r"^\+(?!1)"), abroad).otherwise(american)


def _ssn(text: Column, key: str) -> Column:
    area, group, serial = (F.substring(text, p, k).cast("long") for p, k in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # of 898 areas
    v = permute((place * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    at = F.floor(v / (99 * 9999))
    new = (F.when(at > 664, at + 2).otherwise(at + 1), F.pmod(F.floor(v / 9999), F.lit(99)) + 1, F.pmod(v, F.lit(9999)) + 1)
    return F.concat_ws("-", *(F.lpad(x.cast("long").cast("string"), k, "0") for x, k in zip(new, (3, 2, 4), strict=True)))


def _ip(text: Column, key: str) -> Column:
    part = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    v = permute(part[0] * (1 << 24) + part[1] * (1 << 16) + part[2] * (1 << 8) + part[3], 1 << 16, 1 << 16, key, "ip")
    return F.concat_ws(".", *(F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))


def _date(text: Column, key: str) -> Column:
    """The network covers 270 * 271 values; from the 121 that are no days it goes on until it is at one again."""
    iso = text.rlike(r"^\d{4}")
    sep = F.when(iso, F.substring(text, 5, 1)).otherwise(F.substring(text, 3, 1))
    plain = F.when(iso, F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2))).otherwise(F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)))
    day = F.datediff(F.try_to_date(plain, "yyyy-MM-dd"), F.lit(_FIRST).cast("date")).cast("long")
    one = lambda v: permute(v, 270, 271, key, "date")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(270 * 271 - _DAYS)), one(day), lambda v, _: F.when(v >= _DAYS, one(v)).otherwise(v))
    new = F.date_add(F.lit(_FIRST).cast("date"), walked.cast("int"))
    parts = [F.date_format(new, p) for p in ("yyyy", "MM", "dd")]
    return F.when(day.isNotNull(), F.when(iso, F.concat(parts[0], sep, parts[1], sep, parts[2])).otherwise(F.concat(parts[2], sep, parts[1], sep, parts[0])))


def _letters(text: Column, key: str, kind: str) -> Column:
    """Each digit, small or capital letter moves within its class by a keyed hash of the other half; in a text of
    hexadecimal digits only, within those."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    # for each text once, not for each character: small, capital or no hexadecimal digits
    mode = F.when(text.rlike("^[0-9a-f]+$") & text.rlike("[a-f]"), "x").when(text.rlike("^[0-9A-F]+$") & text.rlike("[A-F]"), "X").otherwise("")

    def moved(part: Column, other: Column, i: Column, mode: Column) -> Column:
        def one(c: Column, at: Column, other: Column) -> Column:
            h = _hash(key, kind, i, at, other)
            out = c
            for low, size in (("0", 10), ("a", 26), ("A", 26), ("\u00e0", 23), ("\u00c0", 23), ("\u00f9", 5), ("\u00d9", 5)):
                high = chr(ord(low) + size - 1)
                out = F.when((c >= low) & (c <= high), F.char(F.lit(ord(low)) + F.pmod(F.ascii(c) - ord(low) + h, F.lit(size)))).otherwise(out)
            digit = F.hex(F.pmod(F.conv(c, 16, 10).cast("long") + h, F.lit(16)))
            return F.when(mode == "x", F.lower(digit)).when(mode == "X", digit).otherwise(out)

        chars = F.filter(F.split(part, ""), lambda c: c != "")
        short = F.when(F.length(other) > LONG, F.sha2(other, 256)).otherwise(other)
        return F.element_at(F.transform(F.array(short), lambda o: F.concat_ws("", F.transform(chars, lambda c, at: one(c, at, o)))), 1)

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(moved(s["l"], s["r"], i, s["m"]).alias("l"), s["r"].alias("r"), s["m"].alias("m"))
        return F.when(i % 2 == 1, left).otherwise(F.struct(s["l"].alias("l"), moved(s["r"], s["l"], i, s["m"]).alias("r"), s["m"].alias("m")))

    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, n).alias("r"), mode.alias("m"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _email(text: Column, key: str) -> Column:
    local = F.substring_index(text, "@", 1)
    return F.concat(_letters(local, key, "email"), F.substring(text, F.length(local) + 1, F.length(text)))


def _secret(text: Column, key: str) -> Column:
    fixed = F.when(text.startswith("AKIA"), F.lit("AKIA")).otherwise(F.lit(""))
    return F.concat(fixed, _letters(F.substring(text, F.length(fixed) + 1, F.length(text)), key, "secret"))


_KINDS = {"email": _email, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date, "card": _card, "secret": _secret}


def _replaced(m: Column, before: Column, key: str) -> Column:
    """struct<kind, new> of one match; null new where validation fails. before: the text up to the match, back to the
    start of the match before it.

    A match is of the first kind, in the order of PATTERNS, whose pattern it fits by itself; look-behind for a
    secret's name can't be seen there, so what fits nothing else is a secret, and so is a value after such a name
    that fails the validation of its kind.
    """
    secret = F.struct(F.lit("secret").alias("kind"), _secret(m, key).alias("new"))
    out = F.when(m.rlike("^AKIA[0-9A-Z]{16}$"), F.struct(F.lit("secret").alias("kind"), F.lit(None).cast("string").alias("new")))
    for kind in ("email", "phone", "ip", "ssn", "date", "card"):
        out = out.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.struct(F.lit(kind).alias("kind"), _KINDS[kind](m, key).alias("new")))
    named = before.rlike(f"{NAMED}$")
    is_secret = lambda r: r.isNull() | (r["kind"] == "secret") | ((r["new"].isNull() | (r["kind"] == "email")) & named)
    return F.element_at(F.transform(F.array(out), lambda r: F.when(is_secret(r), secret).otherwise(r)), 1)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with ``text`` replaced, and ``pii`` (array<struct<kind, old_sha256, new>>: what was replaced, in order;
    old values only as keyed hashes).

    A null text stays null with a null pii, a text without personal data stays as it is with an empty one. Only
    texts with a digit or @ are searched: no kind but secrets can be without, and those are for texts with = or :.
    Other columns pass through, whatever their names, but one named pii is replaced. Repeated rows are done each.
    """
    m_, x_, r_ = free(docs, "pii_matches", "pii_rest", "pii_new")
    maybe = F.col(text).rlike("[0-9@]|[=:] ?(?:[\"'][^\"']{8}|\\S{8})")
    found = docs.withColumn(m_, F.when(maybe, F.regexp_extract_all(F.col(text), F.lit(f"({ANY})"), F.lit(0))))
    found = found.withColumn(x_, F.when(F.size(m_) > 0, F.split(F.col(text), ANY, -1)))
    before = F.zip_with(x_, F.concat(F.array(F.lit("")), m_), lambda x, m: F.concat(m, x))
    each = F.zip_with(m_, F.slice(before, 1, F.size(m_)), lambda m, b: F.struct(m.alias("old"), _replaced(m, b, key).alias("to")))
    found = found.withColumn(r_, F.when(F.size(m_) > 0, each))
    pieces = F.zip_with(x_, r_, lambda x, r: F.array(x, F.coalesce(r["to"]["new"], r["old"], F.lit(""))))
    done = F.filter(r_, lambda r: r["to"]["new"].isNotNull())
    pii = F.transform(done, lambda r: F.struct(r["to"]["kind"].alias("kind"), F.sha2(F.concat(F.lit(key), r["old"]), 256).alias("old_sha256"), r["to"]["new"].alias("new")))
    empty = F.array().cast("array<struct<kind:string,old_sha256:string,new:string>>")
    return found.withColumn("pii", F.when(F.col(r_).isNotNull(), pii).when(F.col(text).isNotNull(), empty)).withColumn(text, F.when(F.col(r_).isNotNull(), F.concat_ws("", F.flatten(pieces))).otherwise(F.col(text))).drop(m_, x_, r_)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, "a key for tests only").select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"))
