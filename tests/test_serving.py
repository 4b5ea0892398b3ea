"""Tiers at each row's own time, search through an index, facets kept up to date."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bazaar import schema
from bazaar.operators import curate, feed

START = datetime(2026, 1, 1)


def test_tiers_at_each_rows_time(spark):
    rng = random.Random(3)
    moment = lambda: START + timedelta(microseconds=rng.choice([rng.randrange(10**7), rng.randrange(10**13), rng.randrange(3 * 10**14)]))
    promos = []
    for i in range(150):
        a = moment()
        promos.append((i % 4, rng.randrange(1, 6), a, rng.choice([a, a + timedelta(microseconds=rng.randrange(3 * 10**6)), moment(), START + timedelta(days=3000), None])))
    at = [x for p in promos for x in p[2:] if x] + [moment() for _ in range(200)]
    moments = [(i, rng.choice([0, 1, 2, 3, 9, None]), t + timedelta(microseconds=rng.choice([-1, 0, 0, 1]))) for i, t in enumerate(at)] + [(-1, 1, None)]
    p = spark.createDataFrame(promos, "listing_id long, tier int, starts_at timestamp, ends_at timestamp")
    m = spark.createDataFrame([*moments, moments[0]], "id long, listing_id long, at timestamp")
    got = sorted((r["id"], r["promotion_rank"]) for r in feed.tiers_at(m, p).collect())
    best = lambda k, t: max([x[1] for x in promos if t and x[0] == k and x[3] and x[2] <= t <= x[3]], default=0)
    assert got == sorted((i, best(k, t)) for i, k, t in [*moments, moments[0]]) and len({r for _, r in got}) > 3
    assert feed.tiers_at(m.limit(0), p).collect() == [] and feed.tiers_at(m, p.limit(0)).where("promotion_rank <> 0").isEmpty()


def test_only_intervals_of_asked_listings_are_cut(spark):
    p = spark.range(1000).selectExpr("id as listing_id", "1 as tier", "timestamp'2020-01-01 00:00:01' as starts_at", "timestamp'2024-02-03 04:05:06' as ends_at")
    m = spark.createDataFrame([(1, 7, START + timedelta(days=10**4)), (2, 5000, START)], "id long, listing_id long, at timestamp")
    plan = feed.tiers_at(m, p)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("level") < plan.index("LeftSemi")  # below what cuts them
    assert sorted((r["id"], r["promotion_rank"]) for r in feed.tiers_at(m.withColumn("at", F.lit("2022-02-02").cast("timestamp")), p).collect()) == [(1, 1), (2, 0)]


def test_a_long_interval_is_few_blocks(spark):
    p = spark.createDataFrame([(0, 10**9 + 7), (5, 6), (63, 65), (7, 7), (9, 3)], "a long, b long")
    rows = p.select("a", "b", feed._whole_blocks(F.col("a"), F.col("b")).alias("w")).collect()
    for r in rows:
        assert len(r["w"]) <= 14 * feed._LEVELS and sum(8 ** x["level"] for x in r["w"]) == max(0, r["b"] - r["a"])
    small = [r for r in rows if r["b"] < 100]
    for r in small:
        assert sorted(s for x in r["w"] for s in range(x["block"] * 8 ** x["level"], (x["block"] + 1) * 8 ** x["level"])) == list(range(r["a"], r["b"]))


def listings(spark, n=300):
    rng = random.Random(8)
    words = ["Studio", "студия", "МОРЕ", "100%", "a_b", "quiet", "Σας", None, ""]
    text = lambda: rng.choice([None, " ".join(w for w in (rng.choice(words) for _ in range(4)) if w)])
    rows = [(i, rng.choice(["rent", "jobs", "location"]), rng.choice(["Медина", "Мекка", None]), text(), text(), rng.choice(["published", "published", "pending"])) for i in range(n)]
    return schema.empty(spark, "listing").unionByName(spark.createDataFrame(rows, "id long, category string, city string, title string, summary string, status string"), allowMissingColumns=True).cache()


@pytest.mark.parametrize("q", ["studio", "СТУДИЯ море", "море", "0%", "ab", "100% QUIET", "nothing like it", "ует", "σας", " quiet "])
def test_search_through_the_index(spark, q):
    c = listings(spark)
    for ascii_only in (False, True):
        index = feed.search_index(c, ascii_only)
        ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
        assert ids(feed.search(c, index, q, ascii_only, category="rent")) == ids(feed.found(c, q=q, ascii_only=ascii_only, category="rent"))
    looked_at = feed.candidates(feed.search_index(c), "nothing like it")
    assert looked_at.count() == 0 and feed.candidates(feed.search_index(c), "ab") is None


def test_facets_kept_up_to_date(spark):
    rng = random.Random(5)
    state = {i: ("rent", "a", None, "d", "published") for i in range(40)}
    row = lambda: (rng.choice(["rent", "jobs", None]), rng.choice(["a", "b", None]), rng.choice(["s", "t", None]), rng.choice(["d", None]), rng.choice(["published", "pending"]))
    table = lambda rows: schema.empty(spark, "listing").unionByName(spark.createDataFrame([(i, *r) for i, r in rows], "id long, category string, city string, subcategory string, district string, status string"), allowMissingColumns=True)
    view = feed.facet_sets(table(state.items()))
    for step in range(3):
        before, after = dict(state), dict(state)
        for i in rng.sample(sorted(state), 12):
            after.pop(i)
        after |= {i: row() for i in [*rng.sample(sorted(after), 9), *range(100 * step + 50, 100 * step + 65)]}
        changed = [i for i in before | after if before.get(i) != after.get(i)]
        view = feed.facet_merge(view, feed.facet_changes(table((i, before[i]) for i in changed if i in before), table((i, after[i]) for i in changed if i in after)))
        state = after
    whole = lambda df: sorted(map(str, df.collect()))
    assert whole(view) == whole(feed.facet_sets(table(state.items())))


def test_the_export_is_one_document_in_order(spark, tmp_path):
    c = listings(spark).repartition(5).withColumn("title", F.concat_ws("\n", "title", F.lit('комма, "кавычка"')))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    n = curate.write_bundle(c, str(tmp_path / "out.json"), "https://cdn/")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    items = [r["item"] for r in curate.export(c, "https://cdn/").collect()]
    want = '{"ads":' + json.dumps(schema.ADS, separators=(",", ":")) + ',"items":[' + ",".join(items) + "]}"
    assert n == len(items) and (tmp_path / "out.json").read_bytes() == want.encode()
    ids = [x["id"] for x in json.loads(want)["items"]]
    assert ids == sorted(ids) and len(ids) > 100
    assert curate.write_bundle(c.limit(0), str(tmp_path / "none.json")) == 0 and json.loads((tmp_path / "none.json").read_text())["items"] == []
