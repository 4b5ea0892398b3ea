import hashlib
import random
import re

import pytest

from bazaar.llm import conversations
from bazaar.llm.conversations import Repair, damage, fault, repair, turns

ROWS = "conv_id long, turn long, role string, text string, kind string, audit long"


def brute_force(rows, width=2):
    """Every sequence of edits of (role, text) rows with up to ``width`` insertions at each place: the least (cost, audit, turns)."""
    seen, ways = set(), [(0, "", ())]

    def insert(ways):
        out, new = list(ways), list(ways)
        for _ in range(width):
            new = [(c + 3, a + "I", t + (f"{r}:",)) for c, a, t in new for r in ("user", "assistant")]
            out += new
        # only what the grammar can still begin with
        good = [w for w in out if re.fullmatch("(s?(ua)*u?)?", "".join(x[:1] for x in w[2]))]
        best = {}
        for w in good:
            k = "".join(x[:1] for x in w[2])[-1:] + ("s" if "".join(x[:1] for x in w[2]) == "s" else "")
            if k not in best or w < best[k]:
                best[k] = w
        return list(best.values()) if len(rows) > 4 else good

    ways = insert(ways)
    for role, text in rows:
        what = fault(text, (role, text) in seen)
        seen.add((role, text))
        new = [(c + 4, a + "D", t) for c, a, t in ways]
        if what in ("", "truncated"):
            more = 3 if what else 0
            new += [(c + more, a + "K", t + (f"{role}:{text}",)) for c, a, t in ways]
            new += [(c + 3 + more, a + "R", t + (f"{r}:{text}",)) for c, a, t in ways for r in ("user", "assistant")]
        ways = insert(new)
    cost, audit, out = min(w for w in ways if re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in w[2])))
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def fold(rows):
    state, seen = Repair(), set()
    for i, (role, text) in enumerate(rows):
        state.add(i, role, text, (role, text) in seen)
        seen.add((role, text))
    return state.result()[-3:]


@pytest.mark.parametrize("most,often", [(4, 64), (4, 1), (9, 1), (9, 64)])
def test_like_every_sequence_of_edits(most, often, monkeypatch):
    monkeypatch.setattr(conversations, "OFTEN", often)
    pick = random.Random(most + often)
    for _ in range(250):
        rows = [(pick.choice(["system", "user", "assistant", "user", "assistant", "tool"]), pick.choice(["a.", "b!", "c", "", " ", "d?  ", "e.", "f."])) for _ in range(pick.randint(1, most))]
        assert fold(rows) == brute_force(rows), rows


def test_long_conversations_hold_little():
    state = Repair()
    for i in range(20_000):
        state.add(i, "user" if i % 2 else "assistant", f"{i}.", False)
        assert all(len(p.audit) < 200 for p in state.paths if p)
    assert len(state.result()[6]) >= 20_000


def rows_of(spark):
    hot = [(7, i, "user" if i % 2 else "assistant", f"text {i % 50}.") for i in range(500)]
    some = [(1, 0, "user", "hello."), (1, 1, "assistant", "hi."), (2, None, None, None), (2, 5, "user", "x"), (2, 5, "user", "x"), (None, 1, "user", "who?"), (None, 2, "assistant", "no."), (3, 4, "system", ""), (4, 0, "system", "s."), (4, 9, "assistant", "é" * 70_000 + "."), (5, 3, "tool", "t."), (6, 0, "", "no role.")]
    return spark.createDataFrame([(*r, "x", 1) for r in hot + some], ROWS)


def test_nulls_ties_and_turns(spark):
    rows = rows_of(spark)
    got = {r["conv_id"]: r for r in repair(rows).collect()}
    by = {}
    for r in rows.collect():
        by.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["role"] or " " if r["role"] is None else r["role"], " " if r["text"] is None else r["text"]))
    for conv, some in by.items():
        some = [(role, text) for _, _, role, text in sorted(some)]
        if len(some) < 10:
            assert (got[conv]["cost"], got[conv]["audit"], got[conv]["repaired_sha256"]) == brute_force(some), conv
    assert set(got) == set(by) and got[2]["gaps"] == 0 and got[4]["gaps"] == 8 and got[2]["duplicate"] == 1 and got[7]["duplicate"] == 450 and got[3]["audit"] == "D"
    # the turns themselves, and what they say of the digest
    whole = {}
    for r in sorted(turns(rows, repair(rows)).collect(), key=lambda r: r["place"]):
        whole.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, r in got.items():
        assert hashlib.sha256("\n".join(whole.get(conv, [])).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in whole.get(conv, [])))


def test_damage_and_lost_conversations(spark):
    from zlib import crc32

    one = lambda k: next((c, t) for c in range(1000) for t in range(3) if crc32(f"{c}:{t}".encode()) % 20 == k)
    rows = spark.createDataFrame([(*one(k), "assistant", "a. b!") for k in range(6)], "conv_id long, turn long, role string, text string")
    got = sorted((r["role"], r["text"]) for r in damage(rows).collect())
    assert got == sorted([("assistant", ""), ("assistant", "a b"), ("assistant", "a. b!"), ("assistant", "a. b!"), ("user", "a. b!"), ("assistant", "a. b!")])
    lost = {r["conv_id"]: r for r in repair(damage(rows), rows).collect()}[one(0)[0]]
    assert tuple(lost)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    empty = spark.createDataFrame([], ROWS)
    assert repair(empty).collect() == [] and turns(empty, repair(empty)).collect() == []
