"""Messages of channels to an append-only archive of posts: albums, cursors, idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.operators.runs import runs

MESSAGE = "channel_id long, tg_msg_id long, posted_at timestamp, text string, media_path string, media_phash string, grouped_id long, edited_at timestamp"
FIRST_RUN = 500


def fresh(messages: DataFrame, channels: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages of enabled channels past their cursor, the oldest ``limit`` of each channel; without a limit, 500 of a
    channel that has no cursor yet, and all of the others."""
    of = channels.where("enabled").select(F.col("id").alias("channel_id"), F.coalesce("last_msg_id", F.lit(0)).alias("last_msg_id"))
    new = messages.join(of, "channel_id").where("tg_msg_id > last_msg_id")
    most = F.lit(limit) if limit is not None else F.when(F.col("last_msg_id") == 0, FIRST_RUN)
    placed = runs(new, "channel_id", "tg_msg_id", row="__n")
    return placed.where(F.col("__n") <= F.coalesce(most, F.col("__n"))).drop("__n", "last_msg_id")


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def not_empty(messages: DataFrame) -> DataFrame:
    """Without messages that have neither text nor media."""
    return messages.where(not_blank(F.col("text")) | F.col("media_path").isNotNull())


def islands(messages: DataFrame, by: str = "channel_id", order: str = "tg_msg_id", group: str = "grouped_id") -> DataFrame:
    """messages plus ``island``: runs of one group, in order; a message of no group is one by itself."""
    return runs(messages, by, order, group, row="__row", run="island").drop("__row")


def albums(messages: DataFrame) -> DataFrame:
    """A post of each island: the first message with text, else the first, gives id, times and text; paths in order;
    the hash is the first of a message with a path. Posts with neither text nor paths are left out."""
    fields = [c for c in ("tg_msg_id", "posted_at", "text", "media_path", "media_phash", "grouped_id", "edited_at")]
    rows = islands(messages).groupBy("channel_id", "island").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("m"))
    first = lambda found: F.try_element_at(found, F.lit(1))
    lead = F.coalesce(first(F.filter("m", lambda x: not_blank(x["text"]))), first(F.col("m")))
    paths = F.filter(F.transform("m", lambda x: x["media_path"]), lambda p: p.isNotNull())
    hashed = first(F.filter("m", lambda x: x["media_path"].isNotNull() & x["media_phash"].isNotNull()))
    out = rows.select("channel_id", lead.alias("lead"), paths.alias("media_paths"), hashed["media_phash"].alias("media_phash"), F.try_element_at(F.col("m"), F.lit(-1))["tg_msg_id"].alias("last_id"))
    out = out.select("channel_id", "lead.tg_msg_id", "lead.grouped_id", "lead.posted_at", "lead.edited_at", "lead.text", first(F.col("media_paths")).alias("media_path"), "media_paths", "media_phash", "last_id")
    return out.where(not_blank(F.col("text")) | (F.size("media_paths") > 0))


def hold_open(messages: DataFrame) -> DataFrame:
    """Without the last island of each channel if it is an album, which may go on in the next batch."""
    numbered = islands(messages)
    last = numbered.groupBy(F.col("channel_id").alias("__channel")).agg(F.max("island").alias("__last"))
    held = numbered.join(last, F.col("channel_id").eqNullSafe(F.col("__channel")))
    return held.where((F.col("island") < F.col("__last")) | F.col("grouped_id").isNull()).drop("__last", "__channel", "island")


def absent(rows: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the archive hasn't, one of each."""
    return rows.dropDuplicates(keys).join(archive.select(*keys), keys, "left_anti")


def cursors(channels: DataFrame, messages: DataFrame) -> DataFrame:
    """channels with last_msg_id raised to the last message that isn't empty."""
    seen = not_empty(messages).groupBy(F.col("channel_id").alias("id")).agg(F.max("tg_msg_id").alias("__seen"))
    return channels.join(seen, "id", "left").withColumn("last_msg_id", F.greatest("last_msg_id", "__seen")).select(*channels.columns)


def ensure_channels(channels: DataFrame, configured: DataFrame) -> DataFrame:
    """channels with those of configured (username, title, trust) that are new; a title only where there was none,
    and never another trust."""
    wanted = configured.select("username", F.col("title").alias("__title"), F.col("trust").alias("__trust")).dropDuplicates(["username"])
    kept = channels.join(wanted.select("username", "__title"), "username", "left").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "__title")).select(*channels.columns)
    new = wanted.join(channels.select("username"), "username", "left_anti")
    base = channels.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__base"))
    ids = F.row_number().over(Window.orderBy("username"))  # as many as the configuration has
    rows = new.withColumn("__n", ids).join(F.broadcast(base)).select((F.col("__base") + F.col("__n")).alias("id"), "username", F.col("__title").alias("title"), F.lit(True).alias("enabled"), F.coalesce("__trust", F.lit(50)).cast("int").alias("trust"), F.lit(0).cast("long").alias("last_msg_id"))
    return kept.unionByName(rows, allowMissingColumns=True)
