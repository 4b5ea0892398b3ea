"""What readers ask of published cards: facets, ranked pages, one card, counters, review and the publishing gate."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar import schema
from bazaar.functions.money import format_price

PAGE, MOST, CHIPS = 48, 200, 12
SEARCHED = ["title", "summary", "city", "subcategory"]


def section(category: str | None) -> Column:
    """The section asked for, else all but places."""
    return F.col("category") == category if category else F.col("category") != schema.LOCATION


def published(listings: DataFrame) -> DataFrame:
    return listings.where("status = 'published'")


def matches(q: str, ascii_only: bool = False) -> Column:
    """Any searched column holds q, stripped, literally, whatever its case; ascii_only: case of A-Z only, with % and _
    as wildcards."""
    q = q.strip()
    if ascii_only:
        fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        low = "".join(x.lower() if x.isascii() else x for x in q)
        hits = [fold(F.col(c)).like(f"%{low}%") for c in SEARCHED]
    else:
        hits = [F.lower(F.col(c)).contains(q.lower()) for c in SEARCHED]
    out = F.lit(False)
    for h in hits:
        out = out | F.coalesce(h, F.lit(False))
    return out


def _fold(text: Column, ascii_only: bool) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if ascii_only else F.lower(text)


def search_index(listings: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(gram, id): each three letters in a row of a searched column, case folded as ``matches`` does. To be written sorted by gram."""
    each = F.explode(F.array(*(_fold(F.col(c), ascii_only) for c in SEARCHED)))
    texts = listings.select("id", each.alias("t")).where(F.length("t") >= 3)
    return texts.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring("t", i, F.lit(3)))).alias("gram")).select("gram", "id").distinct()


def candidates(index: DataFrame, q: str, ascii_only: bool = False) -> DataFrame | None:
    """(id) of the cards that have all the grams of q; None if q has no three letters in a row, so that all may match."""
    q = q.strip()
    pieces = re.split("[%_]", "".join(x.lower() if x.isascii() else x for x in q)) if ascii_only else [q.lower()]
    grams = sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)})
    if not grams:
        return None
    return index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")


def search(listings: DataFrame, index: DataFrame, q: str, ascii_only: bool = False, **predicates) -> DataFrame:
    """found(listings, q=q), read through an index of all cards: only those with all grams of q are looked at."""
    some = candidates(index, q, ascii_only)
    return found(listings if some is None else listings.join(some, "id", "left_semi"), q=q, ascii_only=ascii_only, **predicates)


def found(listings: DataFrame, category: str | None = None, district: str | None = None, city: str | None = None, subcategory: str | None = None, q: str | None = None, ascii_only: bool = False) -> DataFrame:
    """Published cards that meet all predicates given; an empty argument is none."""
    out = published(listings).where(section(category))
    for name, value in (("district", district), ("city", city), ("subcategory", subcategory)):
        if value:
            out = out.where(F.col(name) == value)
    return out.where(matches(q, ascii_only)) if q and q.strip() else out


def promotion_rank(promotions: DataFrame, as_of: datetime) -> DataFrame:
    """(listing_id, promotion_rank): the highest tier that runs at as_of, both ends included."""
    runs = F.lit(as_of).cast("timestamp").between(F.col("starts_at"), F.col("ends_at"))
    return promotions.where(runs).groupBy("listing_id").agg(F.max("tier").alias("promotion_rank"))


#: Blocks of time: seconds, and 2 ** 3 of a level in one of the next.
_BITS, _LEVELS = 3, 11


def _div(x: Column, by: int) -> Column:
    """x // by, exactly."""
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def _whole_blocks(start: Column, end: Column) -> Column:
    """array<struct<level, block>> that the seconds from start up to end, without it, are made of: few of each level."""
    parts = []
    bound = lambda level: (-F.shiftright(-start, _BITS * level), F.shiftright(end, _BITS * level))
    for level in range(_LEVELS):
        (lo, hi), (up, down) = bound(level), bound(level + 1)
        top = level == _LEVELS - 1
        # whole blocks of the next level are left to it; without one, all of this level is in the first part
        first = hi if top else F.when(up < down, F.shiftleft(up, _BITS)).otherwise(hi)
        for a, b in ((lo, first),) if top else ((lo, first), (F.when(up < down, F.shiftleft(down, _BITS)), hi)):
            some = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
            parts.append(_at_level(some, level))
    return F.concat(*parts)


def _at_level(blocks: Column, level: int) -> Column:
    return F.transform(blocks, lambda x: F.struct(F.lit(level).alias("level"), x.alias("block")))


def tiers_at(moments: DataFrame, promotions: DataFrame, at: str = "at") -> DataFrame:
    """moments (listing_id, at, and what else they have) plus promotion_rank: the highest tier of the listing that runs at the
    row's own time, both ends included; 0 where none does, or where listing or time is null.

    An interval is cut into blocks of 8 ** level seconds, fourteen of a level at most, however long it is; of each block the
    highest tier is kept. So a moment meets one row for each level, and those intervals that begin or end in its second.
    """
    asked = moments.select("listing_id", F.col(at).alias("__at")).where("listing_id is not null and __at is not null").distinct()
    asked, second = asked.withColumn("__us", F.unix_micros(F.col("__at").cast("timestamp"))), 1_000_000
    begin, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("starts_at", "ends_at"))
    runs = promotions.select("listing_id", "tier", begin.alias("__begin"), end.alias("__end")).where("__begin <= __end")
    # of an interval up to a hundred rows are made: only of those of listings that are asked for
    runs = runs.join(asked.select("listing_id").distinct(), "listing_id", "left_semi")
    inner = _whole_blocks(-_div(-F.col("__begin"), second), _div(F.col("__end"), second))
    blocks = runs.select("listing_id", "tier", F.explode(inner).alias("b")).groupBy("listing_id", "b.level", "b.block").agg(F.max("tier").alias("tier"))
    own = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(_div(F.col("__us"), second), _BITS * k).alias("block")) for k in range(_LEVELS)))
    inside = asked.select("listing_id", "__at", F.explode(own).alias("o")).select("listing_id", "__at", "o.level", "o.block").join(blocks, ["listing_id", "level", "block"]).select("listing_id", "__at", "tier")
    edges = runs.withColumn("__second", F.explode(F.array_distinct(F.array(*(_div(F.col(c), second) for c in ("__begin", "__end"))))))
    touched = asked.withColumn("__second", _div(F.col("__us"), second)).join(edges, ["listing_id", "__second"]).where(F.col("__us").between(F.col("__begin"), F.col("__end")))
    best = inside.unionByName(touched.select("listing_id", "__at", "tier")).groupBy("listing_id", "__at").agg(F.max("tier").alias("promotion_rank")).withColumnRenamed("__at", at)
    return moments.join(best, ["listing_id", at], "left").withColumn("promotion_rank", F.coalesce("promotion_rank", F.lit(0))).select(*moments.columns, "promotion_rank")


def ranked(cards: DataFrame, promotions: DataFrame, as_of: datetime) -> DataFrame:
    rank = promotion_rank(promotions, as_of).withColumnRenamed("listing_id", "id")
    return cards.join(rank, "id", "left").withColumn("promotion_rank", F.coalesce("promotion_rank", F.lit(0)))


def rank_order(flag: bool = False) -> list[Column]:
    """Promoted first, by tier or, with ``flag``, all alike; then the latest, then those with a photo, then by id."""
    if flag:
        return [F.desc(F.col("promotion_rank") != 0), F.desc("last_seen_at"), F.coalesce(F.col("photo") == "", F.lit(True)), F.col("id")]
    return [F.desc("promotion_rank"), F.desc("last_seen_at"), F.col("photo").isNull(), F.col("id")]


def media_url(path: Column, base: str = "") -> Column:
    bare = F.ltrim(path, F.lit("/"))
    if base:
        return F.concat(F.lit(base.rstrip("/") + "/"), bare)
    return F.concat(F.lit("/media/"), F.element_at(F.split(bare, "/"), -1))


def serialize(cards: DataFrame, base: str = "") -> DataFrame:
    """The feed's columns with defaults, photos falling back to the cover, addresses of media, the section's title."""
    gallery = F.when(F.size("photos") > 0, F.col("photos")).when(F.col("photo") != "", F.array("photo")).otherwise(F.array().cast("array<string>"))
    values = {
        "contacts": F.coalesce("contacts", F.array().cast(schema.CONTACTS)),
        "details": F.coalesce("details", F.create_map().cast("map<string,string>")),
        "photo": F.when(F.col("photo") != "", media_url(F.col("photo"), base)),
        "photos": F.transform(gallery, lambda p: media_url(p, base)),
    }
    have = set(cards.columns)
    kinds = {f.name: f.dataType for f in schema.struct("listing")}
    for name in schema.FEED:
        if name not in have:
            cards = cards.withColumn(name, F.lit(None).cast(kinds[name]))
    extra = [(F.col("promotion_rank") != 0).alias("promoted"), "promotion_rank"] if "promotion_rank" in have else []
    return cards.select(*(values.get(c, F.col(c)).alias(c) for c in schema.FEED), schema.category_title(F.col("category")).alias("category_title"), *extra)


@dataclass
class Page:
    total: int
    items: DataFrame
    has_more: bool


def feed(listings: DataFrame, promotions: DataFrame, as_of: datetime, limit: int = PAGE, offset: int = 0, base: str = "", **predicates) -> Page:
    if not 0 <= limit <= MOST or offset < 0:
        raise ValueError(f"limit is 0 to {MOST}, offset 0 or more")
    cards = found(listings, **predicates)
    total = cards.count()
    page = ranked(cards, promotions, as_of).orderBy(*rank_order()).offset(offset).limit(limit)
    return Page(total, serialize(page, base), offset + max(0, min(limit, total - offset)) < total)


def count_by(cards: DataFrame, key: str) -> DataFrame:
    """(key, count) of values that are given, most frequent first."""
    some = cards.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return some.groupBy(F.col(key).alias("key")).count().orderBy(F.desc("count"), "key")


def chips(cards: DataFrame, key: str, expanded: bool = False) -> DataFrame:
    """count_by, of which the first twelve are shown until the list is expanded."""
    counts = count_by(cards, key)
    return counts if expanded else counts.limit(CHIPS)


def category_counts(cards: DataFrame) -> DataFrame:
    """(slug, title, count) of the sections of ads in their order, empty and unknown ones left out."""
    dim = F.broadcast(schema.categories(cards.sparkSession).where("ord is not null"))
    return dim.join(cards.groupBy(F.col("category").alias("slug")).count(), "slug").orderBy("ord").select("slug", "title", "count")


def city_counts(cards: DataFrame, category: str | None = None) -> DataFrame:
    """(key, count) of every city, those without a card in the section too."""
    inside = F.coalesce(section(category), F.lit(False))
    some = cards.where("city is not null and city <> ''")
    return some.groupBy(F.col("city").alias("key")).agg(F.count_if(inside).alias("count")).orderBy(F.desc("count"), "key")


def totals(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count_if(F.col("category") != schema.LOCATION).alias("ads_total"), F.count_if(F.col("category") == schema.LOCATION).alias("locations_total"))


def facets(listings: DataFrame, city: str | None = None, category: str | None = None) -> dict[str, DataFrame]:
    cards = published(listings)
    in_city = cards.where(F.col("city") == city) if city else cards
    narrow = in_city.where(section(category))
    return {"categories": category_counts(in_city), "cities": city_counts(cards, category), "subcategories": count_by(narrow, "subcategory"), "districts": count_by(narrow, "district"), "totals": totals(in_city)}


def facet_sets(listings: DataFrame) -> DataFrame:
    """All facets at once, from one scan by grouping sets: (facet, city, category, key, count)."""
    cards = published(listings).select("city", "category", "subcategory", "district")
    view = cards.groupingSets([["city", "category", "subcategory"], ["city", "category", "district"], ["city", "category"]], "city", "category", "subcategory", "district").agg(F.count("*").alias("count"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 1, "subcategory").when(F.col("g") == 2, "district").otherwise("category")
    key = F.when(F.col("g") == 1, F.col("subcategory")).when(F.col("g") == 2, F.col("district")).otherwise(F.col("category"))
    return view.select(facet.alias("facet"), "city", "category", key.alias("key"), "count").where("key is not null")


def facet_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed cards do to facet_sets: signed counts. before, after: the rows of these cards as they were and as they are; new
    cards are in after alone, removed ones in before alone."""
    return facet_merge(facet_sets(after), facet_sets(before).withColumn("count", -F.col("count")))


def facet_merge(view: DataFrame, changes: DataFrame) -> DataFrame:
    """facet_sets kept up to date: the counts of view with those of changes added, none that is 0."""
    return view.unionByName(changes).groupBy("facet", "city", "category", "key").agg(F.sum("count").alias("count")).where("count <> 0")


def _filled(*parts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(p, F.lit("")) for p in parts))


def card_view(cards: DataFrame, as_of: Column, in_city: bool = False) -> DataFrame:
    """What a card shows (rows of serialize): place (subcategory, then the district if a city is chosen, else the city),
    text (what it is for, else the summary), foot (the price, else the section), freshness, and the title's first letter in
    place of a missing photo."""
    place = F.filter(F.array("subcategory", "district" if in_city else "city"), lambda x: x != "")
    return cards.select(
        "id", place.alias("place"), "title", _filled(F.col("details")["purpose"], F.col("summary")).alias("text"),
        _filled(format_price(F.col("price_amount"), F.col("price_currency"), F.col("price_period")), F.col("category_title")).alias("foot"),
        freshness(F.col("last_seen_at"), as_of).alias("freshness"), "photo",
        F.when(F.col("photo").isNull(), _filled(F.substring(F.trim("title"), 1, 1), F.lit("·"))).alias("placeholder"),
    )


#: What the page of a card says beside its text, in order.
FACTS = ["hours", "price", "audience", "landmark", "rooms", "area_sqm", "city", "district", "repost_count"]


def detail_view(cards: DataFrame) -> DataFrame:
    """What the page of a card shows (rows of serialize): facts (array of struct<name, value>, those that are given; reposts
    from two on), actions (addresses of the map and of each contact), the gallery and its first photo."""
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    value = {c: F.col("details")[c] for c in FACTS[:4]} | {c: F.col(c) for c in ("city", "district")}
    value |= {c: F.when(F.col(c) != 0, plain(c)) for c in ("rooms", "area_sqm")} | {"repost_count": F.when(F.col("repost_count") > 1, plain("repost_count"))}
    facts = F.filter(F.array(*(F.struct(F.lit(c).alias("name"), value[c].alias("value")) for c in FACTS)), lambda f: f["value"] != "")
    contact = F.transform("contacts", lambda c: F.when(c["type"] == "phone", F.concat(F.lit("tel:"), c["value"])).otherwise(F.concat(F.lit("https://t.me/"), c["value"])))
    actions = F.concat(F.filter(F.array("map_url"), lambda u: u != ""), contact)
    return cards.select("id", facts.alias("facts"), actions.alias("actions"), "photos", F.try_element_at("photos", F.lit(1)).alias("shown"))


def source_url(username: Column, msg: Column) -> Column:
    return F.concat(F.lit("https://t.me/"), username, F.lit("/"), msg.cast("string"))


def sources(occurrences: DataFrame, raw: DataFrame, channels: DataFrame) -> DataFrame:
    """(listing_id, channel, url, posted_at) of every occurrence that a card took in."""
    posts = raw.select(F.col("id").alias("raw_message_id"), "channel_id", "tg_msg_id", "posted_at")
    of = channels.select(F.col("id").alias("channel_id"), "username", "title")
    rows = occurrences.where("listing_id is not null").select("listing_id", "raw_message_id").join(posts, "raw_message_id").join(of, "channel_id")
    return rows.select("listing_id", F.coalesce("title", "username").alias("channel"), source_url(F.col("username"), F.col("tg_msg_id")).alias("url"), "posted_at")


def detail(listing_id: int, listings: DataFrame, promotions: DataFrame, occurrences: DataFrame, raw: DataFrame, channels: DataFrame, as_of: datetime, base: str = "") -> DataFrame:
    """The published card with its sources, latest first; no row if there is none."""
    card = serialize(ranked(published(listings).where(F.col("id") == listing_id), promotions, as_of), base)
    of = sources(occurrences.where(F.col("listing_id") == listing_id), raw, channels)
    each = of.groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct("posted_at", "channel", "url")), asc=False).alias("sources")).withColumnRenamed("listing_id", "id")
    none = F.array().cast("array<struct<posted_at:timestamp,channel:string,url:string>>")
    return card.join(each, "id", "left").withColumn("sources", F.coalesce("sources", none))


def review(suggestions: DataFrame, occurrences: DataFrame, listings: DataFrame, limit: int = 20) -> DataFrame:
    """Open doubts, the highest scores first."""
    o = occurrences.select(F.col("id").alias("occurrence_id"), F.col("title").alias("occurrence_title"))
    card = listings.select(F.col("id").alias("listing_id"), F.col("title").alias("listing_title"))
    return suggestions.where("resolved_at is null").join(o, "occurrence_id").join(card, "listing_id").orderBy(F.desc("score"), "occurrence_id", "listing_id").limit(limit)


def publish_ready(listings: DataFrame, occurrences: DataFrame, suggestions: DataFrame) -> DataFrame:
    """listings, where pending cards are published unless an occurrence of theirs has an open doubt, or they were
    published from what is not a listing."""
    doubt = suggestions.where("resolved_at is null").select(F.col("occurrence_id").alias("id"))
    blocked = occurrences.join(doubt, "id", "left_semi").where("listing_id is not null").select(F.col("listing_id").alias("id")).distinct().withColumn("blocked", F.lit(True))
    gate = (F.col("status") == "pending") & F.col("blocked").isNull()
    return listings.join(blocked, "id", "left").withColumn("status", F.when(gate, "published").otherwise(F.col("status"))).drop("blocked").select(*listings.columns)


def stats(channels: DataFrame, raw: DataFrame, occurrences: DataFrame, listings: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row of counters."""
    parts = [
        channels.agg(F.count_if("enabled").alias("channels")),
        raw.agg(F.count("*").alias("raw_messages")),
        occurrences.agg(F.count("*").alias("occurrences")),
        listings.agg(F.count("*").alias("listings"), F.count_if(F.col("status") == "published").alias("published"), F.coalesce(F.sum(F.col("repost_count") - 1), F.lit(0)).alias("merged")),
        suggestions.agg(F.count_if(F.col("resolved_at").isNull()).alias("suggestions")),
    ]
    out = parts[0].withColumn("__one", F.lit(1))
    for p in parts[1:]:  # one row each
        out = out.join(p.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def stats_by_category(listings: DataFrame) -> DataFrame:
    counts = published(listings).groupBy("category").count()
    return counts.select("category", schema.category_title(F.col("category")).alias("title"), "count").orderBy(F.desc("count"), "category")


def freshness(seen: Column, as_of: Column) -> Column:
    """Bucket of days since a card was seen."""
    days = F.datediff(as_of.cast("date"), seen.cast("date"))
    return F.when(days <= 0, "day").when(days < 7, "week").when(days < 31, "month").otherwise("older")


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Slavic form of a noun after n."""
    ten, hundred = n % 10, n % 100
    return F.when(hundred.between(11, 14), many).when(ten == 1, one).when(ten.between(2, 4), few).otherwise(many)


def per_source_count(df: DataFrame, source: str, name: str = "in_source") -> DataFrame:
    return df.withColumn(name, F.count("*").over(Window.partitionBy(source)))
