import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bazaar import schema
from bazaar.operators import curate, feed, ingest, resolve
from bazaar.sources import tables
from bazaar.streaming import collect

AS_OF = datetime(2026, 8, 11)
FLAT = "Сдаётся двухкомнатная квартира в Медине, рядом мечеть, мебель новая. 2500 SAR. Тел 0512345678"
AGAIN = "Сдаётся двухкомнатная квартира в Медине рядом мечеть, мебель новая!!! 2500 SAR, телефон +966512345678"
LATER = "🔥 Двухкомнатная квартира в Медине, рядом мечеть, мебель новая, сдаётся 2550 SAR +966 51 234 5678"
STUDIO = "Студия для одного человека у вокзала, без мебели, только девушкам. 900 SAR. Тел 0512345678"


@pytest.fixture
def store(spark, tmp_path):
    return tables.Store(spark, f"file://{tmp_path}/db")


def setup(store, posts, trust=((1, 50), (2, 50))):
    spark = store.spark
    rows = [(i, f"chan{i}", t, True, 0) for i, t in trust]
    store.write("channel", spark.createDataFrame(rows, "id long, username string, trust int, enabled boolean, last_msg_id long"))
    rows = [(i + 1, c, 100 + i, datetime(2026, 8, day), t, paths) for i, (c, day, t, paths) in enumerate(posts)]
    raw = spark.createDataFrame(rows, "id long, channel_id long, tg_msg_id long, posted_at timestamp, text string, media_paths array<string>")
    store.write("raw_message", raw.withColumn("media_path", F.try_element_at("media_paths", F.lit(1))))


def run(store):
    parsed = collect.parse_new(store, AS_OF)
    return parsed, collect.resolve_new(store, AS_OF)


def cards(store):
    return store.read("listing").orderBy("id").collect()


def test_reposts_become_one_card(store):
    setup(store, [(1, 1, FLAT, []), (2, 3, AGAIN, []), (1, 10, LATER, [])])
    parsed, counts = run(store)
    (card,) = cards(store)
    assert parsed == 3 and counts == {"parsed": 3, "merged": 2, "created": 1}
    assert card.repost_count == 3 and card.first_seen_at == datetime(2026, 8, 1) and card.last_seen_at == datetime(2026, 8, 10)
    assert run(store) == (0, {"parsed": 0, "merged": 0, "created": 0}) and len(cards(store)) == 1
    assert {r.listing_id for r in store.read("listing_occurrence").collect()} == {card.id}


def test_one_agent_two_flats(store):
    setup(store, [(1, 1, FLAT, []), (1, 2, STUDIO, [])])
    run(store)
    assert len(cards(store)) == 2


def test_trust_takes_the_text(store):
    setup(store, [(1, 1, FLAT, []), (2, 2, AGAIN, [])], trust=((1, 10), (2, 90)))
    run(store)
    (card,) = cards(store)
    of = {r.id: r.raw_message_id for r in store.read("listing_occurrence").collect()}
    assert of[card.canonical_occurrence_id] == 2 and card.title == AGAIN[:120]


@pytest.mark.parametrize(("albums", "want"), [((["a.jpg"], ["b.jpg"]), ["a.jpg", "b.jpg"]), ((["s.jpg"], ["s.jpg"]), ["s.jpg"]), ((["a", "b", "c"], []), ["a", "b", "c"])])
def test_galleries(store, albums, want):
    setup(store, [(1, 1, FLAT, albums[0]), (2, 2, AGAIN, albums[1])])
    run(store)
    (card,) = cards(store)
    assert card.photos == want and card.photo == want[0]


def test_runs_in_parts_find_earlier_cards(store):
    setup(store, [(1, 1, FLAT, [])])
    run(store)
    more = store.spark.createDataFrame([(2, 2, 200, datetime(2026, 8, 3), AGAIN, None, None)], "id long, channel_id long, tg_msg_id long, posted_at timestamp, text string, media_path string, media_paths array<string>")
    store.write("raw_message", store.read("raw_message").unionByName(more, allowMissingColumns=True))
    assert run(store) == (1, {"parsed": 1, "merged": 1, "created": 0})
    assert [c.repost_count for c in cards(store)] == [2]


def test_window_overrides_and_doubts(store):
    setup(store, [(1, 1, FLAT, []), (2, 2, AGAIN, []), (1, 3, STUDIO, [])])
    collect.parse_new(store, AS_OF)
    args = [store.read(t) for t in ("listing_occurrence", "raw_message", "channel")]
    late = resolve.resolve(*args, datetime(2026, 12, 1))
    assert late["listing"].count() == 3
    ruled = store.spark.createDataFrame([(2, None)], "occurrence_id long, listing_id long")
    assert resolve.resolve(*args, AS_OF, overrides=ruled)["listing"].count() == 3
    old = store.spark.createDataFrame([(7, "rent", "published", datetime(2026, 8, 1), datetime(2026, 8, 1), 1)], "id long, category string, status string, first_seen_at timestamp, last_seen_at timestamp, repost_count int")
    listings = schema.empty(store.spark, "listing").unionByName(old, allowMissingColumns=True)
    ruled = store.spark.createDataFrame([(3, 7)], "occurrence_id long, listing_id long")
    out = resolve.resolve(*args, AS_OF, listings, ruled)
    assert {(r.occurrence_id, r.listing_id) for r in out["link"].collect()} >= {(3, 7)}
    assert {r.id: r.repost_count for r in out["listing"].collect()} == {7: 2, 8: 2}
    assert resolve.run_counts(out["link"]).first().asDict() == {"parsed": 3, "merged": 1, "created": 2}


def test_publishing_waits_for_doubts(spark):
    listings = schema.empty(spark, "listing").unionByName(spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "rejected"), (4, "published")], "id long, status string"), allowMissingColumns=True)
    occ = spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id long, listing_id long")
    sugg = spark.createDataFrame([(10, 9, None), (20, 9, AS_OF), (30, 9, None)], "occurrence_id long, listing_id long, resolved_at timestamp")
    got = {r.id: r.status for r in feed.publish_ready(listings, occ, sugg).collect()}
    assert got == {1: "pending", 2: "published", 3: "rejected", 4: "published"}


def listing_rows(spark):
    cols = "id long, category string, city string, subcategory string, district string, title string, summary string, photo string, photos array<string>, status string, last_seen_at timestamp, repost_count int"
    day = lambda d: datetime(2026, 8, d)
    rows = [
        (1, "rent", "Медина", "flat", "a", "Квартира 100%", None, None, None, "published", day(1), 2),
        (2, "rent", "Мекка", None, "a", "Studio", "у МОРЯ", "x/p.jpg", None, "published", day(3), 1),
        (3, "jobs", "Медина", "", None, "Водитель", None, "q.jpg", ["q.jpg", "r.jpg"], "published", day(3), 1),
        (4, "location", "Таиф", "park", None, "Парк", None, None, None, "published", day(4), 1),
        (5, "sale", "Абха", None, None, "Дом", None, None, None, "pending", day(5), 1),
        (6, "odd", "Мекка", None, None, "Нечто", None, None, None, "published", day(2), 1),
    ]
    return schema.empty(spark, "listing").unionByName(spark.createDataFrame(rows, cols), allowMissingColumns=True)


def promotions(spark):
    rows = [(1, 1, 2, datetime(2026, 8, 1), AS_OF), (2, 1, 1, datetime(2026, 8, 1), AS_OF), (3, 2, 5, datetime(2026, 8, 1), datetime(2026, 8, 10))]
    return spark.createDataFrame(rows, "id long, listing_id long, tier int, starts_at timestamp, ends_at timestamp")


def test_feed(spark):
    page = feed.feed(listing_rows(spark), promotions(spark), AS_OF, limit=2)
    items = page.items.collect()
    assert (page.total, page.has_more, [r.id for r in items]) == (4, True, [1, 2])
    assert items[0].promoted and items[0].photos == [] and items[1].photos == ["/media/p.jpg"] and items[1].contacts == []
    assert items[0].category_title == "Аренда жилья"
    rest = feed.feed(listing_rows(spark), promotions(spark), AS_OF, limit=2, offset=2)
    assert ([r.id for r in rest.items.collect()], rest.has_more) == ([3, 6], False)
    of = lambda **k: [r.id for r in feed.feed(listing_rows(spark), promotions(spark), AS_OF, **k).items.collect()]
    assert of(category="location") == [4] and of(city="Мекка") == [2, 6] and of(q=" моря ") == [2]
    assert of(q="100%") == [1] and of(q="%") == [1] and of(q="%", ascii_only=True) == [1, 2, 3, 6] and of(q="STUDIO", ascii_only=True) == [2]
    with pytest.raises(ValueError):
        of(limit=-1)


def test_facets(spark):
    got = {k: [tuple(r) for r in v.collect()] for k, v in feed.facets(listing_rows(spark)).items()}
    assert got["categories"] == [("rent", "Аренда жилья", 2), ("jobs", "Работа", 1)]
    assert got["cities"] == [("Медина", 2), ("Мекка", 2), ("Таиф", 0)]
    assert got["subcategories"] == [("flat", 1)] and got["districts"] == [("a", 2)] and got["totals"] == [(4, 1)]
    narrow = feed.facets(listing_rows(spark), city="Мекка", category="rent")
    assert [tuple(r) for r in narrow["cities"].collect()] == [("Медина", 1), ("Мекка", 1), ("Таиф", 0)]
    sets = feed.facet_sets(listing_rows(spark)).where("facet = 'category'").groupBy("key").agg(F.sum("count")).collect()
    assert dict(map(tuple, sets)) == {"rent": 2, "jobs": 1, "location": 1, "odd": 1}


def test_detail_review_stats(spark):
    occ = spark.createDataFrame([(10, 1, 1, "о1"), (11, 2, 1, "о2")], "id long, raw_message_id long, listing_id long, title string")
    raw = spark.createDataFrame([(1, 1, 5, datetime(2026, 8, 1)), (2, 2, 6, datetime(2026, 8, 2))], "id long, channel_id long, tg_msg_id long, posted_at timestamp")
    chan = spark.createDataFrame([(1, "one", "Один", True), (2, None, "Два", False)], "id long, username string, title string, enabled boolean")
    (card,) = feed.detail(1, listing_rows(spark), promotions(spark), occ, raw, chan, AS_OF).collect()
    assert [(s.channel, s.url) for s in card.sources] == [("Два", None), ("Один", "https://t.me/one/5")]
    assert feed.detail(5, listing_rows(spark), promotions(spark), occ, raw, chan, AS_OF).count() == 0
    sugg = spark.createDataFrame([(10, 2, 0.6, None), (11, 2, 0.65, None), (11, 3, 0.69, AS_OF)], "occurrence_id long, listing_id long, score double, resolved_at timestamp")
    assert [r.occurrence_id for r in feed.review(sugg, occ, listing_rows(spark), 5).collect()] == [11, 10]
    s = feed.stats(chan, raw, occ, listing_rows(spark), sugg).first()
    assert (s.channels, s.raw_messages, s.occurrences, s.listings, s.published, s.merged, s.suggestions) == (1, 2, 2, 6, 5, 1, 2)


def test_albums(spark):
    rows = [(1, 1, "", "a", None, 7), (1, 2, "текст", "b", "h2", 7), (1, 3, "один", None, None, None), (1, 4, None, "c", "h4", 8), (1, 5, " ", None, None, None), (2, 1, "z", None, "hz", 7), (1, 6, "x", "d", None, 7)]
    m = spark.createDataFrame([(c, i, datetime(2026, 8, i), t, p, h, g, None) for c, i, t, p, h, g in rows], ingest.MESSAGE)
    got = {(r.channel_id, r.tg_msg_id): (r.text, r.media_paths, r.media_phash) for r in ingest.albums(m).collect()}
    assert got == {(1, 2): ("текст", ["a", "b"], "h2"), (1, 3): ("один", [], None), (1, 4): (None, ["c"], "h4"), (2, 1): ("z", [], None), (1, 6): ("x", ["d"], None)}
    assert {(r.channel_id, r.tg_msg_id) for r in ingest.hold_open(m).collect()} == {(1, i) for i in range(1, 6)}


def test_stream_collects_once(spark, store, tmp_path):
    store.write("channel", spark.createDataFrame([(1, "a", 50, True, 0), (2, "off", 50, False, 0)], "id long, username string, trust int, enabled boolean, last_msg_id long"))
    land = tmp_path / "land"
    land.mkdir()
    msg = lambda c, i, t, g=None: json.dumps({"channel_id": c, "tg_msg_id": i, "posted_at": f"2026-08-0{i}T00:00:00Z", "text": t, "grouped_id": g, "media_path": f"{i}.jpg" if g else None})
    (land / "1.json").write_text("\n".join([msg(1, 1, FLAT), msg(1, 2, "", 5), msg(1, 3, "album", 5), msg(2, 1, "off")]))
    go = lambda: collect.collect(spark, store, str(land), str(tmp_path / "cp"), AS_OF, True).awaitTermination()
    go()
    go()
    (land / "2.json").write_text("\n".join([msg(1, 3, "album", 5), msg(1, 4, AGAIN)]))
    go()
    assert [(r.tg_msg_id, r.media_paths) for r in store.read("raw_message").orderBy("id").collect()] == [(1, []), (3, ["2.jpg", "3.jpg"]), (4, [])]
    assert store.read("channel").orderBy("id").first().last_msg_id == 4
    assert sorted(r.repost_count for r in cards(store)) == [1, 2]
    assert collect.publish(store) == 2 and collect.publish(store) == 0


def test_fresh_and_channels(spark):
    chan = spark.createDataFrame([(1, "a", "", 50, True, 2), (2, "b", "B", 70, True, 0)], "id long, username string, title string, trust int, enabled boolean, last_msg_id long")
    m = spark.createDataFrame([(c, i) for c in (1, 2) for i in range(1, 7)], "channel_id long, tg_msg_id long")
    assert sorted(map(tuple, ingest.fresh(m, chan, 2).collect())) == [(1, 3), (1, 4), (2, 1), (2, 2)]
    assert ingest.fresh(m, chan).count() == 10
    conf = spark.createDataFrame([("a", "A", 99), ("c", None, None)], "username string, title string, trust int")
    got = {r.username: (r.id, r.title, r.trust) for r in ingest.ensure_channels(chan, conf).collect()}
    assert got == {"a": (1, "A", 50), "b": (2, "B", 70), "c": (3, None, 50)}
    assert collect.collect_all({"x": lambda: 3, "y": lambda: 1 / 0}) == {"x": 3, "y": -1}


def test_curated_places(spark, store, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([
        {"id": "a", "title": "Кафе، улица", "body": "Подборка\n• раз\n• два", "category": "location", "city": "Медина", "photo": "a.jpg", "source": "p1", "mapUrl": "m"},
        {"id": "b", "title": "Парк в Джидде", "body": "Подборка\n• раз", "city": "", "source": "p1"},
        {"id": "c", "title": "x", "source": "p2"},
    ]))
    (tmp_path / "r.json").write_text(json.dumps({"a": {"title": "Кофейня", "details": {"purpose": "кофе", "features": ["а", " ", "б"], "hours": ""}, "no_photo": True}, "c": {"skip": True}}))
    loc = tables.load_locations(spark, str(tmp_path / "l.json"))
    ref = tables.load_refinements(spark, str(tmp_path / "r.json"))
    rows = curate.places(loc, curate.clean_refinements(ref))
    got = {r.external_id: r for r in rows.collect()}
    assert set(got) == {"a", "b"} and got["a"].title == "Кофейня" and got["a"].photo is None and got["a"].details == {"purpose": "кофе", "features": "а; б"}
    assert got["b"].city == "Джидда" and got["b"].summary == "Подборка"
    first = curate.upsert(schema.empty(spark, "listing"), rows, AS_OF)
    store.write("listing", first)
    again = curate.upsert(store.read("listing").withColumn("repost_count", F.lit(5)), rows.withColumn("title", F.lit("new")), datetime(2026, 9, 1)).collect()
    assert sorted((r.id, r.title, r.repost_count, r.first_seen_at) for r in again) == [(1, "new", 5, AS_OF), (2, "new", 5, AS_OF)]
    assert [r.id for r in curate.to_refine(loc, ref).collect()] == ["b"]
    assert tuple(curate.refine_report(rows, loc).first()) == (3, 2, 1, 0)
    assert curate.write_bundle(store.read("listing"), str(tmp_path / "out.json")) == 2
    bundle = json.loads((tmp_path / "out.json").read_text())
    assert bundle["ads"] == schema.ADS and [x["id"] for x in bundle["items"]] == [1, 2]
    assert tables.load_refinements(spark, str(tmp_path / "none.json")).count() == 0


def test_store(spark, store, tmp_path):
    assert store.read("promotion").count() == 0
    rows = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "channel_id long, tg_msg_id long")
    assert store.insert("raw_message", rows, ["channel_id", "tg_msg_id"]) == 2
    assert store.insert("raw_message", rows, ["channel_id", "tg_msg_id"]) == 0
    store.update("raw_message", spark.createDataFrame([(1, "t")], "id long, text string"))
    store.update("raw_message", spark.createDataFrame([(1,)], "id long"))
    assert [(r.id, r.text) for r in store.read("raw_message").orderBy("id").collect()] == [(1, "t"), (2, None)]
    done = []
    steps = {"002": lambda s: done.append(2), "001": lambda s: done.append(1)}
    assert store.migrate(steps, AS_OF) == ["001", "002"] and store.migrate(steps, AS_OF) == [] and done == [1, 2]
    (tmp_path / "c.yml").write_text("channels:\n  - '@one'\n  - username: two\n    trust: 80\n    title: T\n")
    assert [tuple(r) for r in tables.load_channels(spark, str(tmp_path / "c.yml")).collect()] == [("one", None, 50), ("two", "T", 80)]
    assert tables.load_channels(spark, "/nowhere").count() == 0
    df = spark.createDataFrame([('["a"]',), ("oops",), (None,)], "v string")
    assert [r[0] for r in df.select(tables.loads(F.col("v"), "array<string>", F.array())).collect()] == [["a"], [], []]


def test_appends_write_their_rows_only(spark, store):
    rows = lambda *n: spark.createDataFrame([(i, 2) for i in n], "channel_id long, tg_msg_id long")
    store.insert("raw_message", rows(1, 2), ["channel_id"])
    first = store.state()["raw_message"]
    store.insert("raw_message", rows(2, 3), ["channel_id"])
    assert store.state()["raw_message"][:-1] == first and spark.read.parquet(f"{store.root}/{store.state()['raw_message'][-1]}").count() == 1
    assert [(r.id, r.channel_id) for r in store.read("raw_message").orderBy("id").collect()] == [(1, 1), (2, 2), (3, 3)]


def test_updates_write_their_blocks_only(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/db", block=2)
    rows = lambda *n: spark.createDataFrame([(i, i * 10, f"t{i}") for i in n], "id long, channel_id long, text string")
    of = lambda: {store._block(f): f for f in store.state()["raw_message"]}
    store.write("raw_message", rows(1, 2, 3, 4, 5, 6))
    first = of()
    assert sorted(first) == [0, 1, 2, 3] and store.last_id("raw_message") == 6
    store.update("raw_message", spark.createDataFrame([(4, "new"), (99, "nowhere")], "id long, text string"))
    then = of()
    assert {b for b in then if then[b] != first[b]} == {2}
    store.upsert("raw_message", store.read("raw_message").where("id = 6").withColumn("text", F.lit("six")).unionByName(store.read("raw_message").where("id = 1").withColumn("id", F.lit(9).cast("long"))))
    last = of()
    assert {b for b in last if last[b] != then.get(b)} == {3, 4} and store.last_id("raw_message") == 9
    assert [(r.id, r.text) for r in store.read("raw_message").orderBy("id").collect()] == [(1, "t1"), (2, "t2"), (3, "t3"), (4, "new"), (5, "t5"), (6, "six"), (9, "t1")]
    store.update("raw_message", spark.createDataFrame([], "id long, text string"))
    assert of() == last and store.last_id("promotion") == 0
    # nothing stays of writes that no state lists
    for _ in range(tables.KEEP + 1):
        store.write("raw_message", rows(1))
    assert len(store._list(f"{store.root}/raw_message")) == tables.KEEP + 1


def test_appends_look_at_keys_near_the_new_ones(spark, store):
    rows = lambda *n: spark.createDataFrame([(1, i) for i in n], "channel_id long, tg_msg_id long")
    keys = ["channel_id", "tg_msg_id"]
    assert [store.insert("raw_message", rows(*n), keys) for n in ((5, 1, 9), (9, 9, 2), (), (1, 2, 5, 9), (None, 3))] == [3, 1, 0, 0, 2]
    assert sorted(r.id for r in store.read("raw_message").collect()) == [1, 2, 3, 4, 5, 6]


def test_runs_by_parts_give_the_cards_of_one_run(spark, tmp_path):
    """Posts come in one after another, are folded two at a time at most, and leave blocks of cards that don't change alone."""
    posts = [(1, 1, FLAT, []), (1, 2, STUDIO, []), (2, 3, AGAIN, []), (1, 4, "Няня на час, 50 SAR, @nanny_one", []), (2, 10, LATER, [])]
    whole, parts = (tables.Store(spark, f"file://{tmp_path}/{n}", block=2) for n in ("whole", "parts"))
    setup(whole, posts)
    run(whole)
    counts = []
    for n, limits in ((3, (2, 2)), (5, (None,))):
        setup(parts, posts[:n])
        collect.parse_new(parts, AS_OF)
        counts += [collect.resolve_new(parts, AS_OF, limit) for limit in limits]
    assert [(c["parsed"], c["created"]) for c in counts] == [(2, 2), (1, 0), (2, 1)]
    assert cards(parts) == cards(whole) and len(cards(whole)) == 3
    links = lambda s: s.read("listing_occurrence").select("id", "raw_message_id", "listing_id").orderBy("id").collect()
    assert links(parts) == links(whole)
    # the agent's second flat is in doubt, and waits
    doubts = {r.listing_id for r in parts.read("listing_occurrence").join(parts.read("dedup_suggestion").select(F.col("occurrence_id").alias("id")), "id").collect()}
    assert len(doubts) == 1 and collect.publish(parts) == collect.publish(whole) == 2 and collect.publish(parts) == 0
    assert {c.id: c.status for c in cards(parts)} == {c.id: "pending" if c.id in doubts else "published" for c in cards(whole)}


@pytest.mark.parametrize("fails_at", ["dedup_suggestion", "listing", "listing_occurrence"])
def test_a_run_that_stops_between_its_writes_leaves_nothing(store, monkeypatch, fails_at):
    """And the next one does it all, once: the same as a run that never stopped."""
    setup(store, [(1, 1, FLAT, []), (2, 3, AGAIN, []), (1, 4, STUDIO, [])])
    collect.parse_new(store, AS_OF)
    before, real = store.state(), tables.Store._add

    def stop(self, name, df):
        if name == fails_at:
            raise OSError("stopped")
        return real(self, name, df)

    doubt = store.spark.createDataFrame([(1, 2, 0.6, ["x"])], "occurrence_id long, listing_id long, score double, reasons array<string>")
    resolve_ = resolve.resolve
    monkeypatch.setattr(resolve, "resolve", lambda *a, **k: resolve_(*a, **k) | {"suggestion": doubt})
    monkeypatch.setattr(tables.Store, "_add", stop)
    with pytest.raises(OSError, match="stopped"):
        collect.resolve_new(store, AS_OF)
    assert store.state() == before and store.read("listing").count() == 0
    monkeypatch.setattr(tables.Store, "_add", real)
    assert collect.resolve_new(store, AS_OF) == {"parsed": 3, "merged": 1, "created": 2}
    assert sorted(c.repost_count for c in cards(store)) == [1, 2] and store.read("dedup_suggestion").count() == 1
    assert collect.resolve_new(store, AS_OF)["parsed"] == 0 and sorted(c.repost_count for c in cards(store)) == [1, 2]


def test_old_states_are_dropped(store):
    for i in range(6):
        store.write("promotion", store.spark.createDataFrame([(i,)], "id long"))
    assert store.read("promotion").first().id == 5 and len(store._list(f"{store.root}/promotion")) == tables.KEEP + 1 == len(store._manifests())


def test_components_are_folded_as_one_fold_would(spark, monkeypatch):
    """Random posts with few texts, contacts, photos and prices: by components the same cards, links and doubts as a
    fold of each category at once."""
    import random

    rng = random.Random(11)
    base = ["flat with sea view and new furniture", "flat with sea view and new furnitures", "driver wanted for night shifts", "sofa for sale almost new", "studio near the station for one"]
    occ = [(i, i, None, rng.choice(["rent", "jobs", None]), rng.choice(["Медина", "Мекка", None]), f"t{i}", rng.choice([None, 900.0, 910.0, 2500.0]), rng.choice(base) + rng.choice(["", " today", " now"]), [("phone", rng.choice(["+1", "+2", "+3", ""]))] if rng.random() < 0.5 else []) for i in range(120)]
    occ = spark.createDataFrame(occ, f"id long, raw_message_id long, listing_id long, category string, city string, title string, price_amount double, norm_text string, contacts {schema.CONTACTS}")
    occ = schema.empty(spark, "listing_occurrence").unionByName(occ, allowMissingColumns=True)
    raw = spark.createDataFrame([(i, i % 3, datetime(2026, 8, 1 + rng.randrange(9)), [rng.choice("abc")] if rng.random() < 0.4 else None, rng.choice([None, "00000000000000ff", "00000000000000fe", "ff00ff00ff00ff00"])) for i in range(120)], "id long, channel_id long, posted_at timestamp, media_paths array<string>, media_phash string").withColumn("media_path", F.lit(None).cast("string"))
    chan = spark.createDataFrame([(0, 10), (1, 50), (2, 90)], "id long, trust int")
    ruled = spark.createDataFrame([(5, None), (17, None)], "occurrence_id long, listing_id long")
    go = lambda: {k: sorted(map(str, v.drop("updated_at").collect())) for k, v in resolve.resolve(occ, raw, chan, AS_OF, overrides=ruled).items()}
    got = go()
    monkeypatch.setattr(resolve, "_components", lambda rows: rows.withColumn("component", F.col("home")))
    assert got == go() and 10 < len(got["listing"]) < 100 and got["suggestion"]


def test_parsers(spark):
    model = '{"is_listing": true, "category": "flat", "title": "  ", "price_amount": 5.0}'
    df = spark.createDataFrame([(model,), ("{}",), ("bad",)], "v string").select(resolve.from_model(F.col("v")).alias("p")).select("p.*").collect()
    assert [(r.is_listing, r.category, r.title, r.price_amount) for r in df] == [(True, "other", schema.NO_TITLE, 5.0), (False, "other", schema.NO_TITLE, None), (False, "other", schema.NO_TITLE, None)]


def test_frequent_contacts(spark):
    occ = spark.createDataFrame([(i, [("phone", "+1"), ("telegram", "x" if i < 3 else "y")]) for i in range(5)], f"raw_message_id long, contacts {schema.CONTACTS}")
    raw = spark.createDataFrame([(i, 1) for i in range(5)], "id long, channel_id long")
    assert [tuple(r) for r in resolve.common_contacts(occ, raw, 3).collect()] == [(1, ["phone:+1", "telegram:x"])]


def test_labels(spark):
    df = spark.createDataFrame([(1, 0), (2, 3), (5, 10), (11, 40), (21, 1)], "n int, d int").withColumn("seen", F.expr("date_sub(date'2026-08-11', d)"))
    got = [tuple(r) for r in df.select(feed.plural(F.col("n"), "a", "b", "c"), feed.freshness(F.col("seen"), F.lit(AS_OF))).collect()]
    assert got == [("a", "day"), ("b", "week"), ("c", "month"), ("c", "older"), ("a", "week")]
