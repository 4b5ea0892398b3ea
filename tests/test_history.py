import json

import pytest

from bazaar.sources import history, tables
from bazaar.sources.history import HistoryReader, _File
from bazaar.streaming import collect


def line(i, text="a text", **more):
    return json.dumps({"tg_msg_id": i, "posted_at": f"2026-08-{i % 28 + 1:02d}T00:00:00Z", "text": f"{text} {i}", "grouped_id": None} | more) + "\n"


@pytest.fixture
def store(spark, tmp_path):
    s = tables.Store(spark, f"file://{tmp_path}/db")
    rows = [(i, f"c{i}", 50, i != 4, 0) for i in (1, 2, 3, 4)]
    s.write("channel", spark.createDataFrame(rows, "id long, username string, trust int, enabled boolean, last_msg_id long"))
    return s


def archived(store):
    out = {}
    for r in store.read("raw_message").collect():
        out.setdefault(r["channel_id"], []).append(r["tg_msg_id"])
    return {k: sorted(v) for k, v in out.items()}


def test_restarts_read_on_and_a_lost_channel_stops_nobody(spark, store, tmp_path):
    land, faults = tmp_path / "land", []
    land.mkdir()
    (land / "1.jsonl").write_text("".join(line(i) for i in range(1, 8)))
    (land / "2.jsonl").write_text(line(3) + "{damaged\n" + line(5, grouped_id="not a number") + '{"tg_msg_id": 6, "te')
    (land / "4.jsonl").write_text(line(1))
    go = lambda: collect.collect_history(spark, store, str(land), str(tmp_path / "cp"), 5, faults).awaitTermination()
    go()
    # five of a new channel first; the third has no file, the fourth isn't enabled
    assert archived(store)[1][:5] == [1, 2, 3, 4, 5] and archived(store)[2] == [3, 5] and set(archived(store)) == {1, 2}
    assert {c: why.split(":")[0] for c, why in faults} == {2: "line", 3: "FileNotFoundError"}
    go()
    assert archived(store)[1] == list(range(1, 8))
    cursors = {r["id"]: r["last_msg_id"] for r in store.read("channel").collect()}
    assert cursors == {1: 7, 2: 5, 3: 0, 4: 0}
    with (land / "2.jsonl").open("a") as f:
        f.write('xt": "whole now"}\n' + line(9))
    (land / "3.jsonl").write_text(line(2))
    faults.clear()
    go()
    go()
    assert archived(store) == {1: list(range(1, 8)), 2: [3, 5, 6, 9], 3: [2]} and not faults


def test_places_are_found_by_bisection(tmp_path, monkeypatch):
    monkeypatch.setattr(history, "BLOCK", 256)
    p = tmp_path / "7.jsonl"
    p.write_text("".join(line(2 * i) + ("??\n" if i % 11 == 0 else "") for i in range(1, 400)) + "{cut off")
    f = _File(str(p))
    assert f.last_id() == 798
    for after in (0, 1, 2, 399, 400, 797, 798, 900):
        start = f.past(after)
        ids = [i for _, x in f.lines(start) if (i := history._id(x)) is not None]
        assert [i for i in ids if i > after] == [2 * i for i in range(1, 400) if 2 * i > after] and sum(i <= after for i in ids) < 15


def test_offsets_never_go_back(tmp_path):
    (tmp_path / "1.jsonl").write_text("".join(line(i) for i in range(1, 20)))
    r = HistoryReader({"path": str(tmp_path), "cursors": '{"1": 0, "9": 4}', "limit": "5"}, None)
    assert r.latestOffset() == {"upto": {"1": 5, "9": 4}, "faults": {"9": "FileNotFoundError"}}
    # restarted from a checkpoint that is further than the cursors
    (span,) = r.partitions({"upto": {"1": 12}, "faults": {"9": "x"}}, {"upto": {"1": 15, "9": 4}, "faults": {"9": "x"}})[:1] or [None]
    assert (span.after, span.upto) == (12, 15) and r.latestOffset()["upto"]["1"] == 19
