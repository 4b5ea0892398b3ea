import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaar import schema
from bazaar.functions import money, phash, score, similarity, text
from bazaar.operators import resolve


def ask(spark, values, fn, kind="string"):
    """fn over a column of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize("compose", [True, False])
def test_normalize_text(spark, compose):
    a = "🔥 Сдаётся квартира!!! 2500 SAR\nТел: +966 51 234 5678 @agent_one https://t.me/x\n#аренда\nПодписывайтесь на канал"
    b = "сдается КВАРТИРА 2500 sar телефон 0512345678"
    got = ask(spark, [a, b, "", None, "a_b  c\td", "Наш канал: тест\nend"], lambda c: text.normalize_text(c, compose))
    assert got[0] == got[1] == "сдается квартира 2500 sar"
    assert got[2:] == ["", None, "a_b c d", "end"]


def test_nfkc(spark):
    assert ask(spark, ["ﬁ²", "plain", None], lambda c: text.nfkc(c)) == ["fi2", "plain", None]


def test_phones(spark):
    same = ["0512345678", "+966512345678", "966512345678", "00966512345678", "512345678", "05 12 34 56 78", "+966 51-234-5678", "٠٥١٢٣٤٥٦٧٨"]
    assert ask(spark, same, text.normalize_phone) == ["+966512345678"] * 8
    assert ask(spark, ["2500", "комнат: 3", None, "0112345678", "1" * 16], text.normalize_phone) == [None, None, None, "+0112345678", None]
    assert ask(spark, ["звоните 0512345678 или +7 999 123-45-67, 051-234-5678", None], text.extract_phones) == [["+966512345678", "+79991234567"], []]


def test_usernames_and_contacts(spark):
    got = ask(spark, ["@samir_flats, https://t.me/samir_flats t.me/flats_daily t.me/joinchat x@mail.com @abc"], text.extract_usernames)
    assert got == [["samir_flats", "flats_daily", "mail"]]
    contacts = ask(spark, ["@User_1 0512345678"], text.extract_contacts)[0]
    assert [tuple(c) for c in contacts] == [("phone", "+966512345678"), ("telegram", "user_1")]


def test_prices(spark):
    got = ask(spark, ["2 500 SAR", "3000 риалов", "1,200 ريال", "2500", "2.500 SAR", "1,5 руб", "1.2.3 usd", "0 SAR", "10\n0 €", "٢٥٠ ريال", None], money.parse_price)
    assert [tuple(x) if x else None for x in got] == [(2500.0, "SAR"), (3000.0, "SAR"), (1200.0, "SAR"), None, (2.5, "SAR"), (15.0, "RUB"), (123.0, "USD"), None, None, (250.0, "SAR"), None]


def test_price_bucket(spark):
    values = [2500.0, 2600.0, 9000.0, None, 0.0, 1.0, 1.15, 1e12, 0.5]

    def plain(x):
        if not x or x <= 0:
            return "na"
        n = 0
        while x >= 1.15:
            x, n = x / 1.15, n + 1
        return f"b{n // 3}"

    assert ask(spark, values, money.price_bucket, "double") == [plain(v) for v in values]
    assert plain(2500.0) == plain(2600.0) == "b18"


def test_titles_and_summaries(spark):
    assert ask(spark, ["\n  Первая \nвторая", "", None, "x" * 200], text.title_fallback) == ["Первая", schema.NO_TITLE, schema.NO_TITLE, "x" * 120]
    assert ask(spark, [" a ", "", None], text.summary_fallback) == ["a", None, None]
    assert ask(spark, ["Кафе، улица، 1", "короткий, город", "д" * 60 + ", хвост длинный очень", None], text.title_of) == ["Кафе", "короткий, город", "д" * 60, schema.NO_TITLE]
    body = "Вступление\n📍 адрес\nещё\n• пункт один\nпосле"
    df = spark.createDataFrame([(body, True), (body, False), ("", True), (None, True), ("• сразу", True), ("x 📍 y\nz 📍 w\nq", True)], "b string, s boolean")
    assert [r[0] for r in df.select(text.summary_of(F.col("b"), F.col("s"))).collect()] == ["Вступление\nещё", "Вступление\nещё\n• пункт один\nпосле", None, None, None, "x 📍 y"]
    pairs = spark.createDataFrame([(" Медина ", "x"), ("", "Мечеть в Джидде"), (None, "Из Мекки в Медину"), (None, None)], "c string, t string")
    assert [r[0] for r in pairs.select(text.city_of(F.col("c"), F.col("t"))).collect()] == ["Медина", "Джидда", None, None]
    assert ask(spark, ["سلام", "abc"], text.has_arabic) == [True, False]
    assert ask(spark, ["<a href='x'>\"&\"</a>"], text.escape_html) == ["&lt;a href=&#39;x&#39;&gt;&quot;&amp;&quot;&lt;/a&gt;"]


def test_hamming(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "fffffffffffffffe"), ("0", None), ("xyz", "0"), ("a", "a")], "a string, b string")
    assert [r[0] for r in df.select(phash.hamming(F.col("a"), F.col("b"))).collect()] == [1, 64, 64, 0]


@pytest.mark.parametrize("distance", [0, 3, 8, 16])
def test_near_hashes_are_all_found(spark, distance):
    rng = random.Random(distance)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for most in (1, distance, distance + 1):
            values.append(v ^ sum(1 << k for k in rng.sample(range(64), most)))
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    rows = [(v, g) for v in signed for g in ("a", "b")]
    df = spark.createDataFrame([*rows, *rows, (None, "a")], "v long, g string")
    apart = lambda x, y: ((x ^ y) & ((1 << 64) - 1)).bit_count()
    want = {(g, x, y, apart(x, y)) for g in "ab" for x in signed for y in signed if x < y and apart(x, y) <= distance}
    got = [tuple(r) for r in phash.near_pairs(df, "v", distance, ("g",)).collect()]
    assert set(got) == want and len(got) == len(want) and (want or not distance)
    assert sum(r + 1 for _, _, r in phash.pieces(distance)) == distance + 1


def test_near_hashes_meet_in_packed_units(spark, monkeypatch):
    monkeypatch.setattr(phash, "PART", 64)
    rng = random.Random(5)
    values = [rng.getrandbits(63) for _ in range(150)]
    values = sorted({*values, *(v ^ sum(1 << k for k in rng.sample(range(63), 6)) for v in values)})
    near = phash.near_pairs(spark.createDataFrame([(v,) for v in values], "v long"), "v", 8)
    # no table of looked up values is a row, let alone broadcast
    assert not near._jdf.queryExecution().toString().count("BroadcastHashJoin")
    got = [tuple(r) for r in near.collect()]
    want = {(x, y, (x ^ y).bit_count()) for x in values for y in values if x < y and (x ^ y).bit_count() <= 8}
    assert set(got) == want and len(got) == len(want) >= 150


@pytest.mark.parametrize(("distance", "few", "met"), [(8, 0, 7), (8, 10**8, 7), (1, 0, 1000), (16, 0, 7)])
def test_near_hashes_of_a_unit(monkeypatch, distance, few, met):
    monkeypatch.setattr(phash, "FEW", few)
    monkeypatch.setattr(phash, "MET", met)
    rng = random.Random(distance)
    a = [rng.getrandbits(64) for _ in range(60)]
    b = sorted({v ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, distance + 1))) for v in a})
    got = [(int(x), int(y)) for some in phash._met(*(np.array(h, np.uint64) for h in (a, b)), distance) for x, y in zip(*some, strict=True)]
    assert sorted(got) == sorted((x, y) for x in a for y in b if (x ^ y).bit_count() <= distance)


def test_phash(spark):
    rng = np.random.default_rng(2)
    image = rng.random(1024) * 255
    got = ask(spark, [image.tolist(), (image + 3).tolist(), [1.0], None], lambda c: phash.phash(c), "array<double>")
    k = np.arange(32)
    m = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 64) * np.sqrt(2 / 32)
    m[0] /= np.sqrt(2)
    low = (m @ image.reshape(32, 32) @ m.T)[:8, :8]
    want = "".join("1" if x else "0" for x in (low > np.median(low)).ravel())
    assert got[0] == f"{int(want, 2):016x}" and got[2:] == [None, None]


def test_token_set_ratio(spark):
    assert similarity.ratio("a b c", "a b d") == pytest.approx(80)
    assert similarity.ratio("x y", "x y z") == 100 and similarity.ratio("", "a") == 0
    assert similarity.ratio("a b", "c d") == pytest.approx(100 / 3)
    df = spark.createDataFrame([("a b c", "a b d"), (None, "x")], "l string, r string")
    assert [round(r[0], 6) for r in df.select(similarity.token_set_ratio("l", "r")).collect()] == [80.0, 0.0]


def test_lcs():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert similarity.lcs(a, b) == t[-1][-1]


ITEM = "norm_text string, contacts array<struct<type:string,value:string>>, media_phash string, category string, city string, district string, price_amount double, price_currency string, rooms double, area_sqm double"


def item(**k):
    base = {"norm_text": "", "contacts": [], "media_phash": None, "category": "rent", "city": "Медина", "district": None, "price_amount": None, "price_currency": None, "rooms": None, "area_sqm": None} | k
    return tuple(base[f] for f in score.ITEM)


def judge(spark, pairs):
    df = spark.createDataFrame(pairs, f"l struct<{ITEM.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>, r struct<{ITEM.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>, common array<string>, i int")
    return [r["match"] for r in resolve.score_pairs(df, "common").orderBy("i").collect()]


PHONE = [("phone", "+966512345678")]


def test_compare(spark):
    words = "сдается квартира две комнаты рядом с мечетью"
    got = judge(spark, [
        (item(norm_text=words, contacts=PHONE, price_amount=2500.0, rooms=2.0), item(norm_text=words + " срочно", contacts=PHONE, price_amount=2500.0, rooms=2.0), [], 0),
        (item(norm_text="совсем иной рассказ", media_phash="f" * 16, price_amount=2500.0), item(norm_text="переписано полностью заново здесь", media_phash="f" * 15 + "e", price_amount=2500.0), [], 1),
        (item(norm_text=words, contacts=PHONE, price_amount=2500.0, rooms=2.0), item(norm_text="студия у парка новая мебель", contacts=PHONE, price_amount=900.0, rooms=1.0), [], 2),
        (item(), item(category="jobs"), [], 3),
        (item(norm_text="один текст", contacts=PHONE), item(norm_text="zzz yyy xxx www", contacts=PHONE), ["phone:+966512345678"], 4),
        (item(norm_text="тот же", city="Мекка"), item(norm_text="тот же"), [], 5),
        (item(price_amount=100.0, area_sqm=50.0, district="a"), item(price_amount=200.0, area_sqm=80.0, district="b"), None, 6),
    ])
    assert got[0].score >= score.MERGE
    assert got[1].score == pytest.approx(0.55) and got[1].score >= score.REVIEW
    assert got[2].score < score.MERGE and got[3].score == 0.0 and got[4].score < score.MERGE
    assert got[5].score == 1.0 and got[5].reasons == [score.SAYS["text"]]
    assert got[6].score == 0.0 and len(got[6].reasons) == 3


def test_compare_is_the_fold_s_score(spark):
    rng = random.Random(7)
    pick = lambda *x: rng.choice(x)

    def one():
        words = " ".join(rng.choices(["дом", "сад", "море", "рядом", "центр", "новый"], k=rng.randint(0, 6)))
        return item(norm_text=words, contacts=rng.sample([("phone", "+1"), ("telegram", "ab"), ("phone", ""), ("telegram", "cd")], rng.randint(0, 3)), media_phash=pick(None, "0", "ff", "zz", "f" * 16), category=pick("rent", "rent", "jobs", "other"), city=pick(None, "", "Мекка", "Медина"), district=pick(None, "a", "b"), price_amount=pick(None, 0.0, 100.0, 104.0, 150.0), price_currency=pick(None, "SAR", "USD"), rooms=pick(None, 0.0, 1.0, 2.0), area_sqm=pick(None, 50.0, 56.0, 60.0))

    pairs = [(one(), one(), pick([], ["phone:+1"], ["telegram:ab"]), i) for i in range(400)]

    def plain(x):
        d = dict(zip(score.ITEM, x, strict=True))
        return d | {"keys": {f"{t}:{v}" for t, v in d["contacts"] if v}, "bits": int(d["media_phash"], 16) if d["media_phash"] not in (None, "zz") else None}

    for (a, b, common, _), got in zip(pairs, judge(spark, pairs), strict=True):
        assert (got.score, got.reasons) == score.weigh(plain(a), plain(b), set(common))


def test_identity_key(spark):
    rows = [(item(contacts=[("telegram", "a"), ("phone", "+9"), ("phone", "+1")], price_amount=2500.0),), (item(contacts=[("telegram", "b")], city=None, category="x"),), (item(),)]
    kind = ITEM.replace(" string", ":string").replace(" double", ":double").replace(" array", ":array")
    got = [r[0] for r in spark.createDataFrame(rows, f"v struct<{kind}>").select(score.identity_key(F.col("v"))).collect()]
    assert got == ["phone:+1|rent|медина|b18", "telegram:b|other|?|na", None]


def test_categories(spark):
    df = spark.createDataFrame([("rent",), ("nope",), (None,)], "s string")
    assert [tuple(r) for r in df.select(schema.category(F.col("s")), schema.is_category(F.col("s")), schema.category_title(F.col("s"))).collect()] == [("rent", True, "Аренда жилья"), ("other", False, "Другое"), ("other", False, "Другое")]
