import json

import pytest
from pyspark.sql import functions as F

from bazaar.__main__ import main
from bazaar.functions import phash
from bazaar.functions.register import COLUMNS, SQL, apply_function, register
from bazaar.operators import curate, resolve

FLAT = "Сдаётся квартира у моря, две комнаты, 2500 SAR, 0512345678"


def test_commands(spark, tmp_path, capsys):
    land = tmp_path / "land"
    land.mkdir()
    rows = [{"channel_id": 1, "tg_msg_id": i, "posted_at": f"2026-08-0{i}T00:00:00Z", "text": t} for i, t in ((1, FLAT), (2, FLAT + "!"), (3, "Продам диван"))]
    (land / "1.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "c.yml").write_text("channels: ['@one']")
    run = lambda *a: main(["--db", f"file://{tmp_path}/db", "--as-of", "2026-08-11", *a], spark)
    for args in (["collect", str(land), "--channels", str(tmp_path / "c.yml")], ["parse"], ["publish"], ["review"], ["stats"], ["export", str(tmp_path / "out.json")]):
        assert run(*args) == 0
    said = capsys.readouterr().out
    for part in ("posts: 3", "parsed: 3", "merged: 1", "created: 2", "published: 2", "listings: 2", "cards: 2"):
        assert part in said
    assert [x["repost_count"] for x in json.loads((tmp_path / "out.json").read_text())["items"]] == [2, 1]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT nfkc('ﬁ'), round(token_set_ratio('a b c', 'a b d'), 3), phash(array(1.0D))").first() == ("fi", 80.0, None)


def test_sql_functions_say_what_the_columns_say(spark):
    register(spark)
    texts = [None, "", "  ", "Сдаётся: ٠٥٠ 123 45 67, 2 500 риалов\n@Foo_Bar t.me/joinchat", "+7 (916) 123-45-67 WhatsApp 00966512345678 #tag", "номер 966 0512345678 ё ﬁ 1.200.000 ₽ и $15,5", "A & <b> \"q\" 'x', Jeddah", "مكة، شارع 500 ريال", " \n\u00a0first\nsecond", "x" * 90 + ", y", "subscribe now\nkept http://a.b/c 😀", "a\\b 12 sr 3.4.5 usd"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, (args, _, _) in SQL.items():
        if args == "x STRING":
            assert spark.sql(f"SELECT t, {name}(t) FROM {{d}}", d=docs).collect() == docs.select("t", apply_function(name, "t")).collect(), name
    values = spark.createDataFrame([(v, c, p) for v in (None, 0.0, -2.0, 0.5, 1.0, 1.15, 1234567.5, 3e9) for c, p in ((None, None), ("SAR", ""), ("USD", "month"))], "v double, c string, p string")
    both = values.select(apply_function("price_bucket", "v"), apply_function("format_price", "v", "c", "p")).collect()
    assert spark.sql("SELECT price_bucket(v), format_price(v, c, p) FROM {d}", d=values).collect() == both
    hashes = spark.createDataFrame([(a, b) for a in (None, "", "ff", "0f0f0f0f0f0f0f0f", "zz") for b in ("1", "FFFFFFFFFFFFFFFF", None)], "a string, b string")
    assert spark.sql("SELECT hash_distance(a, b) FROM {d}", d=hashes).collect() == hashes.select(apply_function("hash_distance", "a", "b")).collect()
    found = spark.sql("SELECT t, c.value FROM {d}, LATERAL contacts_of(t) AS c", d=docs)
    assert sorted(found.collect()) == sorted(docs.select("t", F.explode(apply_function("extract_contacts", "t")).alias("c")).select("t", "c.value").collect())
    assert set(SQL) == set(COLUMNS)


def test_functions_by_name(spark):
    df = spark.createDataFrame([("a 0512345678", 2500.0)], "t string, n double")
    got = df.select(*(apply_function(*x) for x in (("normalize_text", "t"), ("extract_phones", "t"), ("price_bucket", "n"), ("token_set_ratio", "t", "t"), ("nfkc", "t")))).first()
    assert tuple(got) == ("a", ["+966512345678"], "b18", 100.0, "a 0512345678")


def test_settings_of_the_environment(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("BAZAAR_DB", f" file://{tmp_path}/db ")
    assert main(["stats"], spark) == 0 and "listings: 0" in capsys.readouterr().out
    monkeypatch.setenv("BAZAAR_DB", " ")
    with pytest.raises(SystemExit):
        main(["stats"], spark)


def test_images_are_hashed_by_a_decoder(spark, tmp_path):
    for name, value in (("a", 3), ("b", 200), ("bad", None)):
        (tmp_path / name).write_bytes(b"junk" if value is None else bytes((i * value) % 256 for i in range(1024)))
    decode = lambda content: [float(x) for x in content] if len(content) == 1024 else None
    got = {r["path"].rpartition("/")[2]: r["media_phash"] for r in phash.image_hashes(spark, f"file://{tmp_path}", decode).collect()}
    assert got["bad"] is None and len({got["a"], got["b"]}) == 2 and all(len(got[k]) == 16 for k in "ab")
    assert {r["media_phash"] for r in phash.image_hashes(spark, f"file://{tmp_path}/bad").collect()} == {None}


def test_exports():
    import bazaar

    assert all(callable(getattr(bazaar, n)) or n in ("MERGE", "REVIEW") for n in bazaar.__all__)


def test_batch_results_in_any_order(spark):
    raw = spark.createDataFrame([(1, "a 0512345678"), (2, "b"), (3, "c")], "id long, text string")
    results = spark.createDataFrame([(3, "junk"), (1, '{"is_listing": true, "category": "rent", "title": "T"}'), (2, None)], "id long, payload string")
    got = resolve.parse_results(raw, results, "m").orderBy("raw_message_id").select("raw_message_id", "is_listing", "category", "title", F.size("contacts"), "parse_model").collect()
    assert [tuple(r) for r in got] == [(1, True, "rent", "T", 1, "m"), (3, False, "other", "Без названия", 0, "m")]


def test_photos_are_copied_once(tmp_path):
    for d, names in (("a", ["1.jpg"]), ("b", ["1.jpg", "2.jpg"])):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text(d)
    args = ["x/1.jpg", "2.jpg", "3.jpg", None, "1.jpg"], [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "out")
    assert curate.copy_photos(*args) == 2 and curate.copy_photos(*args) == 0
    assert (tmp_path / "out/1.jpg").read_text() == "a"
