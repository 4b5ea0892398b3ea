"""python -m bazaar --db ROOT COMMAND: collect, parse, publish, review, stats, export."""

from __future__ import annotations

import argparse
import os
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from bazaar.operators import curate, feed, ingest
from bazaar.sources.tables import Store, load_channels
from bazaar.streaming import collect


def env(name: str, default: str | None = None) -> str | None:
    """A setting of the environment without white space around it; the default where it is unset or blank."""
    return os.environ.get(name, "").strip() or default


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="bazaar")
    p.add_argument("--db", default=env("BAZAAR_DB"), help="root of the tables, a path that Spark can write to ($BAZAAR_DB)")
    p.add_argument("--as-of", type=datetime.fromisoformat, default=None, help="now, unless given")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("collect", help="archive new messages of a landing folder")
    c.add_argument("landing")
    c.add_argument("--channels", default=env("BAZAAR_CHANNELS"), help="YAML of channels ($BAZAAR_CHANNELS)")
    f = sub.add_parser("parse", help="parse new posts and fold them into cards")
    f.add_argument("--limit", type=int, default=None, help="posts to fold in this run, the oldest first; all, unless given")
    sub.add_parser("publish", help="publish cards without open doubts")
    r = sub.add_parser("review", help="show open doubts")
    r.add_argument("--limit", type=int, default=20)
    sub.add_parser("stats", help="show counters")
    e = sub.add_parser("export", help="write published cards as one JSON document")
    e.add_argument("path")
    e.add_argument("--media", default=env("BAZAAR_MEDIA", ""), help="base address of media ($BAZAAR_MEDIA)")
    a = p.parse_args(argv)
    if not a.db:
        p.error("--db or $BAZAAR_DB is needed")
    spark = spark or SparkSession.builder.appName("bazaar").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, as_of = Store(spark, a.db), a.as_of or datetime.now(UTC).replace(tzinfo=None)
    if a.command == "collect":
        if a.channels:
            store.write("channel", ingest.ensure_channels(store.read("channel"), load_channels(spark, a.channels)))
        collect.collect(spark, store, a.landing, f"{store.root}/_checkpoint").awaitTermination()
        print("posts:", store.read("raw_message").count())
    elif a.command == "parse":
        print("parsed:", collect.parse_new(store, as_of))
        print(*(f"{k}: {v}" for k, v in collect.resolve_new(store, as_of, a.limit).items()), sep="\n")
    elif a.command == "publish":
        print("published:", collect.publish(store))
    elif a.command == "review":
        for row in feed.review(store.read("dedup_suggestion"), store.read("listing_occurrence"), store.read("listing"), a.limit).collect():
            print(f"[{row['score']:.2f}] {row['occurrence_title']} ~ {row['listing_title']}", *(f"  - {x}" for x in row["reasons"]), sep="\n")
    elif a.command == "stats":
        tables = [store.read(t) for t in ("channel", "raw_message", "listing_occurrence", "listing", "dedup_suggestion")]
        print(*(f"{k}: {v}" for k, v in feed.stats(*tables).first().asDict().items()), sep="\n")
        print(*(f"  {r['title']}: {r['count']}" for r in feed.stats_by_category(store.read("listing")).collect()), sep="\n")
    else:
        print("cards:", curate.write_bundle(store.read("listing"), a.path, a.media))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
