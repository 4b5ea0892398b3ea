"""Incremental collection: a file stream of messages, each batch appended idempotently, then parsed and resolved."""

from __future__ import annotations

import json
import logging
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bazaar.operators import ingest, resolve
from bazaar.operators.feed import publish_ready
from bazaar.operators.staging import staged
from bazaar.sources.history import ChannelHistory
from bazaar.sources.tables import Store

log = logging.getLogger(__name__)


def append_batch(store: Store, messages: DataFrame, open_albums: bool = True) -> int:
    """Archives the posts of a batch past the channels' cursors, then raises these; run again, it adds nothing.

    open_albums=False leaves the last album of each channel to the next batch.
    """
    channels = store.read("channel")
    new = ingest.not_empty(ingest.fresh(messages, channels, limit=1 << 30))
    new = staged(new if open_albums else ingest.hold_open(new))
    posts = ingest.albums(new).drop("last_id").withColumn("fetched_at", F.current_timestamp())
    with store.transaction():
        added = store.insert("raw_message", posts, ["channel_id", "tg_msg_id"], ["posted_at", "channel_id", "tg_msg_id"])
        store.write("channel", ingest.cursors(channels, new))
    return added


def parse_new(store: Store, as_of: datetime, parser=resolve.rules, model: str = "rules") -> int:
    """Occurrences of all posts that have none."""
    rows = resolve.parse(resolve.unparsed(store.read("raw_message"), store.read("listing_occurrence"), None), parser, model, as_of)
    return store.insert("listing_occurrence", rows, ["raw_message_id"], ["raw_message_id"])


def resolve_new(store: Store, as_of: datetime, limit: int | None = None) -> dict[str, int]:
    """Folds occurrences without a card into cards; parsed, merged and created. Cards, links and doubts change together.

    limit: of these the oldest by time of posting, then by post, are placed; the rest waits for another run. Only blocks of cards and
    occurrences that change are written.
    """
    raw, occurrences, listings = (store.read(t) for t in ("raw_message", "listing_occurrence", "listing"))
    todo = occurrences.where("listing_id is null and coalesce(is_listing, true)")
    if limit is not None:
        times = raw.select(F.col("id").alias("raw_message_id"), "posted_at")
        todo = todo.join(times, "raw_message_id").orderBy("posted_at", "raw_message_id").limit(limit).select(*todo.columns)
    out = resolve.resolve(todo, raw, store.read("channel"), as_of, listings, store.read("dedup_override"), occurrences)
    counts = resolve.run_counts(out["link"]).first().asDict()
    # a changed card keeps what the fold doesn't know
    rest = [c for c in listings.columns if c not in out["listing"].columns]
    cards = staged(out["listing"].join(listings.select("id", *rest), "id", "left").select(*listings.columns))
    doubts = out["suggestion"].withColumns({"created_at": F.lit(as_of).cast("timestamp"), "resolved_at": F.lit(None).cast("timestamp")})
    with store.transaction():
        store.insert("dedup_suggestion", doubts, ["occurrence_id", "listing_id"])
        store.upsert("listing", cards)
        store.update("listing_occurrence", out["link"].select(F.col("occurrence_id").alias("id"), "listing_id"))
    return counts


def publish(store: Store) -> int:
    """Publishes cards without open doubts; how many."""
    before = store.read("listing")
    after = publish_ready(before, store.read("listing_occurrence"), store.read("dedup_suggestion"))
    waiting = before.where("status is distinct from 'published'").select("id")
    news = staged(after.where("status = 'published'").select("id", "status").join(waiting, "id", "left_semi"))
    n = news.count()
    if n:
        store.update("listing", news)
    return n


def collect(spark: SparkSession, store: Store, landing: str, checkpoint: str, as_of: datetime | None = None, resolve_too: bool = False) -> StreamingQuery:
    """Drains the landing folder of JSON messages, batch by batch, and stops."""

    def batch(messages: DataFrame, _: int) -> None:
        append_batch(store, messages)
        if resolve_too:
            parse_new(store, as_of)
            resolve_new(store, as_of)

    stream = spark.readStream.schema(ingest.MESSAGE).json(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_history(spark: SparkSession, store: Store, path: str, checkpoint: str, limit: int = ingest.FIRST_RUN, faults: list | None = None) -> StreamingQuery:
    """Archives what the histories of enabled channels (see sources.history) have past their offsets, and stops.

    A channel that can't be read, or a damaged line, is logged and put into ``faults`` as (channel_id, reason); the rest goes on.
    """

    def batch(messages: DataFrame, _: int) -> None:
        messages = staged(messages)
        for r in messages.where("fault is not null").select("channel_id", "fault").limit(1000).collect():
            log.warning("channel %s: %s", r["channel_id"], r["fault"])
            if faults is not None:
                faults.append(tuple(r))
        append_batch(store, messages.where("fault is null").drop("fault"))

    spark.dataSource.register(ChannelHistory)
    cursors = {str(r["id"]): r["last_msg_id"] or 0 for r in store.read("channel").where("enabled").select("id", "last_msg_id").collect()}
    stream = spark.readStream.format("channel_history").option("cursors", json.dumps(cursors)).option("limit", limit).load(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_all(batches: dict[str, callable]) -> dict[str, int]:
    """Runs each channel's collection; a failure counts as -1 and doesn't stop the others."""
    out = {}
    for name, run in batches.items():
        try:
            out[name] = run()
        except Exception:
            log.exception("collection of %s failed", name)
            out[name] = -1
    return out
