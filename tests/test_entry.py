import glob
import os

import duckdb
import pytest

import __spark_entry__
from bazaar import registry
from bazaar.functions import score

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_is_its_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    found = db.execute(registry.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect()) == want


def test_tests_have_names_of_their_own():
    """Two modules of one name end the collection of all tests."""
    names = [os.path.basename(p) for p in glob.glob(os.path.dirname(__file__) + "/**/test_*.py", recursive=True)]
    assert len(names) == len(set(names))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_resolver_keeps_its_invariants(spark):
    got = registry.QUERIES["resolve_cards"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r["repost_count"] for r in got) == docs and sorted(r["id"] for r in got) == list(range(1, len(got) + 1))


def test_all_pairs_of_a_contact_are_scored_by_their_texts(spark, tmp_path):
    """Brute force by the fold's own score; of five contacts one is frequent."""
    words = ["red", "bolt", "small", "green", "nut", "blue"]
    ids = [20 * k + n for k in (4, 5, 11) for n in (0, 1, 3, 10, 11, 12, 17, 19)]
    rows = [(i, " ".join(words[(i + j) % 6] for j in range(3 + i % 3)), 7 + i % 2 * 3, f"b{i % 3}", 100.0 + i % 7) for i in ids]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    item = lambda r: {"norm_text": r[1], "keys": {f"phone:+{r[0] // 20}"}, "bits": None, "category": ["rent", "jobs"][r[2] // 10 % 2], "city": f"c{r[0] % 3}", "district": r[3], "price_amount": r[4], "price_currency": "SAR", "rooms": r[2] % 4, "area_sqm": float(r[2])}
    common = lambda r: {f"phone:+{r[0] // 20}"} if r[0] // 20 % 5 == 0 else set()
    want = {(l[0], r[0]): score.weigh(item(l), item(r), common(l)) for l in rows for r in rows if l[0] < r[0] and l[0] // 20 == r[0] // 20}  # noqa: E741
    got = registry.QUERIES["pair_score_texts"](spark, str(tmp_path)).collect()
    assert {(r["a"], r["b"]): (r["score"], r["reasons"]) for r in got} == {k: (round(s, 6), "; ".join(why)) for k, (s, why) in want.items()} and len(got) == len(want) == 84
    best = {b: max((round(s, 6), -a) for (a, c), (s, _) in want.items() if c == b) for b in {b for _, b in want}}
    assert {r["b"]: (r["score"], -r["a"]) for r in registry.QUERIES["best_match_texts"](spark, str(tmp_path)).collect()} == best


def test_texts_are_composed(spark, tmp_path):
    rows = [(1, "Find the office at 12345", "s"), (2, "Ｆind the oﬃce at １２３４５", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["docs"] for r in registry.QUERIES["exact_text_groups"](spark, str(tmp_path)).collect()] == [2]
    assert [r["repost_count"] for r in registry.QUERIES["resolve_cards"](spark, str(tmp_path)).collect()] == [2]
