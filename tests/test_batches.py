import json
import random
from datetime import datetime, timedelta

from bazaar.operators import batches
from bazaar.sources import tables

AT = datetime(2026, 8, 1)


def test_results_that_are_lost_repeated_late_or_broken(spark, tmp_path):
    """A backend that loses a fifth, breaks a fifth, repeats and mixes the rest; every post is answered once or given up after three."""
    store, rng, now = tables.Store(spark, f"file://{tmp_path}/db"), random.Random(4), AT
    posts = spark.range(1, 41)
    sent: dict[int, list[tuple[int, int]]] = {}
    never = {7, 8}
    assert batches.make(store, posts, now, size=12) == 40 and batches.make(store, posts, now, size=12) == 0
    rows = batches.requests(store).collect()
    assert {r["batch"] for r in rows} == {1, 2, 3, 4} and max(sum(r["batch"] == b for r in rows) for b in (1, 2, 3, 4)) == 12

    def submit(batch, rows):
        if batch == 2 and now == AT:
            raise OSError("busy")
        assert batch not in sent
        sent[batch] = [(r["id"], r["raw_message_id"]) for r in rows.collect()]

    assert batches.send(store, submit, now) == [1, 3, 4]
    late: list[tuple] = []
    for step in range(3):
        now += timedelta(days=2)
        batches.send(store, submit, now)
        answers = []
        for request, post in [x for b in sent.values() for x in b]:
            kind = 0 if post in never else rng.randrange(5) if step < 2 else 2
            if kind == 0:
                late.append((request, json.dumps({"is_listing": True, "title": f"late {post}"})))
            elif kind == 1:
                answers.append((request, rng.choice(["oops", None, "[1]", '{"cut'])))
            else:
                answers += [(request, json.dumps({"is_listing": True, "title": str(post)}))] * rng.choice([1, 2])
        sent.clear()
        rng.shuffle(answers)
        results = spark.createDataFrame([*answers, (9999, "{}")], "id long, payload string")
        counts = batches.settle(store, results, now)
        assert sum(counts.values()) == batches.requests(store).count() and "made" not in counts
        now += timedelta(days=2)
        counts = batches.settle(store, results.limit(0), now)
        assert not counts.get("sent")
        again = batches.make(store, posts, now, size=12)
        assert again == len([1 for p in range(1, 41) if p not in {r["id"] for r in batches.answers(store).collect()}]) or step == 2
    found = {r["id"]: r["payload"] for r in batches.answers(store).collect()}
    assert set(found) == set(range(1, 41)) - never and all(json.loads(v)["title"] == str(k) for k, v in found.items())
    assert batches.make(store, posts, now) == 0
    got = batches.report(store).first()
    assert (got["posts"], got["answered"], got["given_up"]) == (40, 38, 2) and got["failed"] > 0 and got["expired"] >= 6
    # an answer after all, to a request that had been given up
    batches.settle(store, spark.createDataFrame(late[:1], "id long, payload string"), now)
    first = next(r["raw_message_id"] for r in batches.requests(store).collect() if r["id"] == late[0][0])
    assert first in {r["id"] for r in batches.answers(store).collect()}
