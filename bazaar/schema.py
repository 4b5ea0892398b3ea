"""Tables as StructTypes, and the categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Slugs, titles and sections of the directory.
CATEGORIES = {
    "rent": "Аренда жилья",
    "sale": "Продажа недвижимости",
    "jobs": "Работа",
    "services": "Услуги",
    "goods": "Куплю/продам",
    "transport": "Транспорт и перевозки",
    "food": "Еда и доставка",
    "events": "События",
    "location": "Локации и места",
    "other": "Другое",
}
PRICED = ["rent", "sale", "goods", "services", "transport"]
ADS = ["rent", "sale", "jobs", "services", "goods", "transport", "food", "events", "other"]
LOCATION, DEFAULT = "location", "other"
NO_TITLE = "Без названия"

CONTACTS = "array<struct<type:string,value:string>>"
_PLACE = "category string, city string, district string"
_AD = "price_amount double, price_currency string, price_period string, rooms double, area_sqm double"

TABLES = {
    "channel": "id long, tg_id long, username string, title string, enabled boolean, trust int, last_msg_id long, added_at timestamp",
    "raw_message": "id long, channel_id long, tg_msg_id long, posted_at timestamp, text string, media_path string, media_paths array<string>, media_phash string, grouped_id long, edited_at timestamp, fetched_at timestamp",
    "parsed": f"is_listing boolean, {_PLACE}, title string, summary string, {_AD}",
    "listing_occurrence": f"id long, raw_message_id long, listing_id long, is_listing boolean, {_PLACE}, title string, summary string, {_AD}, contacts {CONTACTS}, norm_text string, parse_model string, parsed_at timestamp",
    "listing": f"id long, external_id string, {_PLACE}, subcategory string, title string, summary string, {_AD}, contacts {CONTACTS}, identity_key string, map_url string, lat double, lon double, photo string, photos array<string>, details map<string,string>, source_url string, first_seen_at timestamp, last_seen_at timestamp, repost_count int, status string, canonical_occurrence_id long, updated_at timestamp",
    "promotion": "id long, listing_id long, tier int, starts_at timestamp, ends_at timestamp, note string",
    "dedup_suggestion": "id long, occurrence_id long, listing_id long, score double, reasons array<string>, created_at timestamp, resolved_at timestamp",
    "dedup_override": "id long, occurrence_id long, listing_id long, decided_at timestamp",
    "location": "id string, title string, body string, category string, city string, mapUrl string, photo string, source string",
    "model_request": "id long, raw_message_id long, batch long, attempt int, made_at timestamp",
    "model_event": "request_id long, state string, payload string, at timestamp",
    "schema_migration": "name string, applied_at timestamp",
}

#: The columns of the feed, in order.
FEED = ["id", "category", "subcategory", "city", "district", "title", "summary", "price_amount", "price_currency", "price_period", "rooms", "area_sqm", "contacts", "photo", "photos", "map_url", "source_url", "details", "first_seen_at", "last_seen_at", "repost_count"]


def struct(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], struct(table))


def _titles() -> Column:
    return F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))


def is_category(slug: Column) -> Column:
    return F.coalesce(slug.isin(list(CATEGORIES)), F.lit(False))


def category(slug: Column) -> Column:
    """The slug, or the default where it is unknown or null."""
    return F.when(is_category(slug), slug).otherwise(DEFAULT)


def category_title(slug: Column) -> Column:
    return F.try_element_at(_titles(), category(slug))


def categories(spark: SparkSession) -> DataFrame:
    """slug, title, ord (place among the sections of ads; null for the section of places)."""
    return spark.createDataFrame([(s, t, ADS.index(s) if s in ADS else None) for s, t in CATEGORIES.items()], "slug string, title string, ord int")
