"""Whether two items are one announcement: a weighted score with reasons.

An item is a struct of norm_text, contacts, media_phash, category, city, district, price_amount, price_currency,
rooms and area_sqm. Weights are added as doubles in a fixed order: sums that meet a threshold depend on it.

RULES is the one table of them. Its conditions are over named facts of a pair, which are Columns in ``compare`` and
values in ``weigh``.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaar.functions.money import price_bucket
from bazaar.functions.phash import FAR, SAME_IMAGE, hamming
from bazaar.functions.similarity import ratio as text_ratio
from bazaar.schema import PRICED, category

MERGE, REVIEW = 0.70, 0.55
ITEM = ["norm_text", "contacts", "media_phash", "category", "city", "district", "price_amount", "price_currency", "rooms", "area_sqm"]

# What a reviewer reads.
SAYS = {
    "category": "разные категории", "city": "разные города", "text": "текст совпадает дословно", "phone": "тот же телефон",
    "handle": "тот же telegram-контакт", "common": "контакт совпадает, но он общий для канала", "photo": "то же фото (расстояние %s)",
    "same": "текст почти идентичен (%s%%)", "close": "текст очень похож (%s%%)", "near": "текст похож (%s%%)", "apart": "тексты разные (%s%%)",
    "price": "цена совпадает", "prices": "цена расходится на %s%%", "rooms": "разное число комнат", "area": "разная площадь", "district": "разные районы",
}


#: Groups in the order of addition; of a group the first condition that holds counts: (condition, weight, what is said, fact in it).
RULES = [
    [(lambda f: f["cities"], -0.25, "city", None)],
    [(lambda f: f["own"] & f["phone"], 0.60, "phone", None), (lambda f: f["own"], 0.40, "handle", None), (lambda f: f["shared"], 0.10, "common", None)],
    [(lambda f: f["photo"], 0.40, "photo", "distance")],
    [
        (lambda f: f["texts"] & (f["ratio"] >= 95), 0.50, "same", "ratio"),
        (lambda f: f["texts"] & (f["ratio"] >= 88), 0.30, "close", "ratio"),
        (lambda f: f["texts"] & (f["ratio"] >= 78), 0.15, "near", "ratio"),
        (lambda f: f["texts"] & (f["ratio"] < 55) & f["strange"], -0.10, "apart", "ratio"),
    ],
    [(lambda f: f["priced"] & (f["gap"] <= 0.05), 0.15, "price", None), (lambda f: f["priced"] & (f["gap"] >= 0.25) & f["goods"], -0.35, "prices", "percent")],
    [(lambda f: f["rooms"], -0.20, "rooms", None)],
    [(lambda f: f["sized"] & (f["area"] >= 0.15), -0.15, "area", None)],
    [(lambda f: f["districts"], -0.10, "district", None)],
]


def lifts(least: float) -> list[set[str]]:
    """The smallest sets of facts, named as in SAYS, that make a score of ``least`` or more if nothing speaks against it."""
    found = [{"text"}]
    for some in product(*([None, *(c for c in choices if c[1] > 0)] for choices in RULES)):
        total = 0.0
        for c in some:
            total += c[1] if c else 0.0
        if total >= least:
            found.append({c[2] for c in some if c})
    return [x for x in found if not any(y < x for y in found)]


#: What takes a score to the review threshold.
LIFTS = lifts(REVIEW)


def _given(x: Column) -> Column:
    """Neither null, empty nor 0."""
    return F.coalesce(x.cast("string").isNotNull() & ~x.cast("string").isin("", "0", "0.0"), F.lit(False))


def _differ(a: Column, b: Column) -> Column:
    return _given(a) & _given(b) & (a != b)


def contact_keys(contacts: Column) -> Column:
    """type:value of each contact that has a value."""
    some = F.filter(F.coalesce(contacts, F.array().cast("array<struct<type:string,value:string>>")), lambda c: c["value"] != "")
    return F.transform(some, lambda c: F.concat_ws(":", c["type"], c["value"]))


def _round(x: Column) -> Column:
    """To a whole number, half to even, as text."""
    return F.rint(x).cast("long").cast("string")


def settled(left: Column, right: Column) -> Column:
    """struct<score, reasons> where categories or equal texts decide alone, else null."""
    says = lambda score, key: F.struct(F.lit(score).alias("score"), F.array(F.lit(SAYS[key])).alias("reasons"))
    same = F.coalesce((left["norm_text"] != "") & (left["norm_text"] == right["norm_text"]), F.lit(False))
    return F.when(_differ(left["category"], right["category"]), says(0.0, "category")).when(same, says(1.0, "text"))


def compare(left: Column, right: Column, ratio: Column, common: Column | None = None) -> Column:
    """struct<score, reasons>; ratio: the token-set similarity of the texts (unused where ``settled`` decides);
    common: keys of contacts that are frequent in the channel."""
    common = F.array().cast("array<string>") if common is None else F.coalesce(common, F.array().cast("array<string>"))
    shared = F.array_intersect(contact_keys(left["contacts"]), contact_keys(right["contacts"]))
    personal = F.array_except(shared, common)
    distance = hamming(left["media_phash"], right["media_phash"])
    a, b, s, t = left["price_amount"], right["price_amount"], left["area_sqm"], right["area_sqm"]
    own, photo = F.size(personal) > 0, distance <= SAME_IMAGE
    gap = F.abs(a - b) / F.greatest(a, b)
    facts = {
        "cities": _differ(left["city"], right["city"]), "districts": _differ(left["district"], right["district"]), "rooms": _differ(left["rooms"], right["rooms"]),
        "own": own, "phone": F.exists(personal, lambda k: k.startswith("phone:")), "shared": F.size(shared) > 0, "photo": photo, "distance": distance.cast("string"), "strange": ~photo & ~own,
        "texts": _given(left["norm_text"]) & _given(right["norm_text"]), "ratio": ratio,
        "priced": _given(a) & _given(b) & ~_differ(left["price_currency"], right["price_currency"]), "gap": gap, "percent": gap * 100, "goods": category(left["category"]).isin(PRICED),
        "sized": _given(s) & _given(t), "area": F.abs(s - t) / F.greatest(s, t),
    }
    score, reasons = F.lit(0.0), []
    for choices in RULES:
        weight, reason = F.lit(0.0), F.lit(None).cast("string")
        for when, w, key, fact in reversed(choices):
            hit = F.coalesce(when(facts), F.lit(False))
            said = F.lit(SAYS[key]) if fact is None else F.format_string(SAYS[key], facts[fact] if fact == "distance" else _round(facts[fact]))
            weight, reason = F.when(hit, F.lit(w)).otherwise(weight), F.when(hit, said).otherwise(reason)
        score = score + weight
        reasons.append(reason)
    weighed = F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), F.array_compact(F.array(*reasons)).alias("reasons"))
    return F.coalesce(settled(left, right), weighed)


def weigh(left: dict, right: dict, common: set) -> tuple[float, list[str]]:
    """compare for two items as dicts, with ``keys`` (of contacts, a set) and ``bits`` (of the image, an integer)."""
    differ = lambda f: bool(left[f]) and bool(right[f]) and left[f] != right[f]
    relative = lambda x, y: abs(x - y) / max(x, y) if x and y else 0.0
    if differ("category"):
        return 0.0, [SAYS["category"]]
    if left["norm_text"] and left["norm_text"] == right["norm_text"]:
        return 1.0, [SAYS["text"]]
    shared = left["keys"] & right["keys"]
    personal = shared - common
    distance = FAR if left["bits"] is None or right["bits"] is None else (left["bits"] ^ right["bits"]).bit_count()
    texts = bool(left["norm_text"]) and bool(right["norm_text"])
    gap = relative(left["price_amount"], right["price_amount"])
    facts = {
        "cities": differ("city"), "districts": differ("district"), "rooms": differ("rooms"),
        "own": bool(personal), "phone": any(k.startswith("phone:") for k in personal), "shared": bool(shared), "photo": distance <= SAME_IMAGE, "distance": distance,
        "strange": distance > SAME_IMAGE and not personal, "texts": texts, "ratio": text_ratio(left["norm_text"], right["norm_text"]) if texts else 0.0,
        "priced": bool(left["price_amount"]) and bool(right["price_amount"]) and not differ("price_currency"), "gap": gap, "percent": gap * 100, "goods": left["category"] in PRICED,
        "sized": bool(left["area_sqm"]) and bool(right["area_sqm"]), "area": relative(left["area_sqm"], right["area_sqm"]),
    }
    total, reasons = 0.0, []
    for choices in RULES:
        for when, w, key, fact in choices:
            if when(facts):
                total += w
                reasons.append(SAYS[key] if fact is None else SAYS[key] % (facts[fact] if fact == "distance" else f"{facts[fact]:.0f}"))
                break
    return max(0.0, min(1.0, total)), reasons


def identity_key(item: Column) -> Column:
    """The first phone, else the first contact, with category, city and price bucket; null without a contact."""
    keys = F.array_sort(contact_keys(item["contacts"]))
    first = F.coalesce(F.try_element_at(F.filter(keys, lambda k: k.startswith("phone:")), F.lit(1)), F.try_element_at(keys, F.lit(1)))
    city = F.coalesce(F.nullif(F.lower(item["city"]), F.lit("")), F.lit("?"))
    return F.when(first.isNotNull(), F.concat_ws("|", first, category(item["category"]), city, price_bucket(item["price_amount"])))
