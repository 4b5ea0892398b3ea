"""A ledger of requests to a model: made in bounded batches, sent, and done, failed or expired; only what failed is asked again.

Two tables that only grow: requests, and events of them. What a request's state is follows from its events, so results may
come in any order, late, more than once, or never.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.operators.ids import number
from bazaar.operators.staging import staged
from bazaar.sources.tables import Store

BATCH, ATTEMPTS = 100_000, 3
#: The stronger state of a request wins, whatever the order of its events: a late answer counts, a repeated one changes nothing.
STATES = ["made", "sent", "expired", "failed", "done"]


def requests(store: Store) -> DataFrame:
    """Requests with ``state``, and ``payload`` and ``settled_at`` of the first event of that state."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    last = store.read("model_event").groupBy("request_id").agg(F.max_by(F.struct("state", "payload", "at"), F.struct(rank, -F.unix_micros("at"), "payload")).alias("e"))
    rows = store.read("model_request").join(last.withColumnRenamed("request_id", "id"), "id", "left")
    return rows.select("id", "raw_message_id", "batch", "attempt", "made_at", F.coalesce("e.state", F.lit("made")).alias("state"), "e.payload", F.col("e.at").alias("settled_at"))


def make(store: Store, posts: DataFrame, at: datetime, size: int = BATCH, attempts: int = ATTEMPTS) -> int:
    """Requests, in new batches of ``size`` at most, for posts (id) without one, and for those whose last one failed or expired, up to
    ``attempts`` for each; how many."""
    rank = F.when(F.col("state") == "done", 2).when(F.col("state").isin("failed", "expired"), 0).otherwise(1)
    so_far = requests(store).groupBy(F.col("raw_message_id").alias("id")).agg(F.max("attempt").alias("n"), F.max(rank).alias("rank"))
    new = posts.select("id").distinct().join(so_far, "id", "left").where(f"rank is null or (rank = 0 and n < {int(attempts)})")
    new = staged(new.select(F.col("id").alias("raw_message_id"), (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("attempt")))
    before = store.read("model_request").agg(F.max("id").alias("id"), F.max("batch").alias("batch")).first()
    placed = number(new, ["raw_message_id"], (before["id"] or 0) + 1)
    batch = F.floor((F.col("id") - F.lit((before["id"] or 0) + 1)) / size) + F.lit((before["batch"] or 0) + 1)
    rows = placed.select("id", "raw_message_id", batch.cast("long").alias("batch"), "attempt", F.lit(at).cast("timestamp").alias("made_at"))
    store.append("model_request", rows)
    return new.count()


def _tell(store: Store, rows: DataFrame, state: str, at: datetime, payload: str | None = None) -> None:
    said = F.col(payload) if payload else F.lit(None).cast("string")
    store.append("model_event", rows.select(F.col("id").alias("request_id"), F.lit(state).alias("state"), said.alias("payload"), F.lit(at).cast("timestamp").alias("at")))


def send(store: Store, submit: Callable[[int, DataFrame], None], at: datetime) -> list[int]:
    """Hands each batch that is only made to ``submit`` (its number, its requests); those it took. What it raises leaves that batch
    for the next run and doesn't stop the others."""
    made = staged(requests(store).where("state = 'made'"))
    sent = []
    for (batch,) in sorted(map(tuple, made.select("batch").distinct().collect())):  # as many as there are batches
        rows = made.where(F.col("batch") == batch)
        try:
            submit(batch, rows)
        except Exception:
            continue
        _tell(store, rows, "sent", at)
        sent.append(batch)
    return sent


def settle(store: Store, results: DataFrame, at: datetime, patience: timedelta = timedelta(days=1)) -> dict[str, int]:
    """Takes in results (id of the request, payload: JSON, or null or anything else where the model failed), of which unknown ones are
    left out, and gives up requests that were sent ``patience`` ago without an answer; requests by state."""
    known = staged(results.join(requests(store).select("id", "state"), "id").where("state <> 'done'"))
    good = F.col("payload").isNotNull() & F.coalesce(F.try_parse_json("payload").isNotNull(), F.lit(False)) & F.col("payload").rlike(r"^\s*\{")
    with store.transaction():
        _tell(store, known.where(good), "done", at, "payload")
        _tell(store, known.where(~good), "failed", at, "payload")
    late = requests(store).where("state = 'sent'").where(F.col("settled_at") <= F.lit(at - patience).cast("timestamp"))
    _tell(store, staged(late), "expired", at)
    return {r["state"]: r["count"] for r in requests(store).groupBy("state").count().collect()}


def answers(store: Store) -> DataFrame:
    """(id of the post, payload): the first answer to each post, for resolve.parse_results."""
    done = requests(store).where("state = 'done'")
    return done.groupBy(F.col("raw_message_id").alias("id")).agg(F.min_by("payload", F.struct("settled_at", "attempt")).alias("payload"))


def report(store: Store, attempts: int = ATTEMPTS) -> DataFrame:
    """One row: posts asked about, answered, given up, and requests that failed or expired."""
    count = lambda state: F.count_if(F.col("state") == state)
    by_post = requests(store).groupBy("raw_message_id").agg(F.max((F.col("state") == "done").cast("int")).alias("done"), F.max("attempt").alias("n"), F.max(F.col("state").isin("made", "sent").cast("int")).alias("open"), count("failed").alias("failed"), count("expired").alias("expired"))
    given_up = F.count_if((F.col("done") == 0) & (F.col("open") == 0) & (F.col("n") >= attempts))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return by_post.agg(F.count("*").alias("posts"), F.count_if(F.col("done") == 1).alias("answered"), given_up.alias("given_up"), total("failed"), total("expired"))
