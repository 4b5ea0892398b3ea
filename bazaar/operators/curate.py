"""Curated places: refinements joined to imported records, an upsert into cards, the export of the directory."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar import schema
from bazaar.functions import text
from bazaar.operators.feed import per_source_count, published, serialize
from bazaar.operators.ids import number
from bazaar.operators.staging import shared_folder, staged

REFINEMENT = "title string, summary string, subcategory string, city string, details struct<purpose:string,features:array<string>,hours:string,price:string,audience:string,landmark:string>, no_photo boolean, skip boolean"


def clean_refinements(refined: DataFrame) -> DataFrame:
    """Blank fields to null, the first four features that aren't blank."""
    details = F.struct(*(text.clean(F.col(f"details.{f}")).alias(f) for f in ("purpose", "hours", "price", "audience", "landmark")), text.first_features(F.col("details.features")).alias("features"))
    return refined.select("id", *(text.clean(F.col(c)).alias(c) for c in ("title", "summary", "subcategory", "city")), details.alias("details"), "no_photo", "skip")


def places(locations: DataFrame, refined: DataFrame | None = None) -> DataFrame:
    """Records as cards: what a refinement says, else what the record's text gives; those that it skips are left out.

    Several records of one source post share its text: of those only the introduction is the description.
    """
    refined = refined if refined is not None else locations.sparkSession.createDataFrame([], f"id string, {REFINEMENT}")
    fix = refined.select("id", F.struct(*[c for c in refined.columns if c != "id"]).alias("r"))
    rows = per_source_count(locations, "source").join(fix, "id", "left").where(~F.coalesce("r.skip", F.lit(False)))
    details = F.map_from_entries(F.array(*(F.struct(F.lit(f).alias("key"), F.col(f"r.details.{f}").alias("value")) for f in ("purpose", "hours", "price", "audience", "landmark")), F.struct(F.lit("features").alias("key"), F.array_join("r.details.features", "; ").alias("value"))))
    photo = F.when(~F.coalesce("r.no_photo", F.lit(False)), F.nullif("photo", F.lit("")))
    return rows.select(
        F.col("id").alias("external_id"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit(schema.LOCATION)).alias("category"),
        F.col("r.subcategory").alias("subcategory"),
        F.coalesce(F.nullif("r.title", F.lit("")), text.title_of(F.col("title"))).alias("title"),
        F.coalesce(F.nullif("r.summary", F.lit("")), text.summary_of(F.col("body"), F.col("in_source") > 1)).alias("summary"),
        F.coalesce(F.nullif("r.city", F.lit("")), text.city_of(F.col("city"), F.col("title"))).alias("city"),
        F.col("mapUrl").alias("map_url"), photo.alias("photo"), F.when(photo.isNotNull(), F.array(photo)).alias("photos"),
        text.without_empty(details).alias("details"), F.col("source").alias("source_url"),
    )


def upsert(listings: DataFrame, rows: DataFrame, as_of: datetime, key: str = "external_id") -> DataFrame:
    """listings with rows of the same key written over, but for times seen and reposts, and new ones added as
    published cards with ids behind the last."""
    own = [c for c in rows.columns if c != key]
    now = F.lit(as_of).cast("timestamp")
    news = rows.select(key, F.struct(*own).alias("__new"))
    changed = F.col("__new").isNotNull()
    kept = listings.join(news, key, "left").select(*((F.when(changed, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.when(changed, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c)) for c in listings.columns))
    added = rows.join(listings.where(F.col(key).isNotNull()).select(key), key, "left_anti")
    added = number(added, [key], (listings.agg(F.max("id")).first()[0] or 0) + 1)
    added = added.withColumns({"first_seen_at": now, "last_seen_at": now, "updated_at": now, "repost_count": F.lit(1), "status": F.lit("published")})
    return kept.unionByName(added, allowMissingColumns=True)


def copy_photos(paths: list[str], folders: list[str], target: str) -> int:
    """Copies files by their base names from the first folder that has them, unless they are there; how many."""
    os.makedirs(target, exist_ok=True)
    n = 0
    for name in dict.fromkeys(os.path.basename(p) for p in paths if p):
        found = next((f"{d}/{name}" for d in folders if os.path.isfile(f"{d}/{name}")), None)
        if found and not os.path.exists(f"{target}/{name}"):
            shutil.copyfile(found, f"{target}/{name}")
            n += 1
    return n


def to_refine(locations: DataFrame, refined: DataFrame, force: bool = False) -> DataFrame:
    """Records that have no refinement yet, or all."""
    return locations if force else locations.join(refined.select("id"), "id", "left_anti")


def refine_report(places_: DataFrame, locations: DataFrame) -> DataFrame:
    """One row: records, those of shared posts, with an Arabic title, moved to another city."""
    given = locations.select(F.col("id").alias("external_id"), F.col("source").alias("post"), text.clean(F.col("city")).alias("was"), F.col("title").alias("raw_title"))
    rows = per_source_count(given, "post").join(places_.select("external_id", "city"), "external_id", "left")
    return rows.agg(F.count("*").alias("records"), F.count_if(F.col("in_source") > 1).alias("shared"), F.count_if(text.has_arabic(F.col("raw_title"))).alias("arabic"), F.count_if(F.col("was").isNotNull() & (F.col("was") != F.col("city"))).alias("moved"))


def export(listings: DataFrame, base: str = "") -> DataFrame:
    """A row of JSON for each published card, by id."""
    return serialize(published(listings), base).orderBy("id").select("id", F.to_json(F.struct(*schema.FEED, "category_title")).alias("item"))


def write_bundle(listings: DataFrame, path: str, base: str = "") -> int:
    """{"ads": sections, "items": cards by id} as one compact document at path, on any storage that Spark writes to; how many cards.

    Tasks write the cards as ordered parts; the driver's JVM joins these as streams of bytes, so no row comes to Python.
    """
    spark = listings.sparkSession
    items = staged(export(listings, base))
    parts = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    # a comma behind each card; the last one is left out
    items.orderBy("id").select("item").write.option("lineSep", ",").text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: (jvm.org.apache.hadoop.fs.Path(p), jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf))
    (source, store), (target, other) = at(parts), at(path)
    files = [f for f in store.listStatus(source) if f.getPath().getName().startswith("part-") and f.getLen()]
    files.sort(key=lambda f: int(f.getPath().getName().split("-")[1].split(".")[0]))
    out = other.create(target, True)
    try:
        out.write(bytearray(('{"ads":' + json.dumps(schema.ADS, separators=(",", ":")) + ',"items":[').encode()))
        for i, f in enumerate(files):
            part = store.open(f.getPath())
            jvm.org.apache.commons.io.IOUtils.copyLarge(part, out, 0, f.getLen() - (i == len(files) - 1))
            part.close()
        out.write(bytearray(b"]}"))
    finally:
        out.close()
        store.delete(source, True)
    return items.count()
