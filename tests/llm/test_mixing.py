import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from bazaar.llm import mixing as m


def corpus(seed, n=400):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), "en", rng.choice(["a", "hot", "hot", "hot", "é", "Z", None])) for i in range(n)]


def test_mix(make):
    rows = corpus(1)
    got = m.mix(make(rows), m.rising).collect()
    size = {r[0]: len(re.findall(m.WORDS, r[1] or "")) for r in rows}
    of = Counter()
    for r in rows:
        of[r[3]] += size[r[0]]
    names = sorted(of, key=m.code_points)
    assert names == ["Z", "a", "hot", "é", None]
    want = dict(zip(names, m.targets([of[n] for n in names], [1, 2, 3, 1, 2], sum(of.values()), 3), strict=True))
    assert sum(want.values()) == pytest.approx(sum(of.values())) and all(want[n] <= 3 * of[n] for n in names)
    taken, seen = Counter(), set()
    for r in got:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], of[r["source"]]) and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * len(r["copies"]) and len(r["copies"]) <= 3
        assert [c.copy for c in r["copies"]] == list(range(len(r["copies"]))) and all(0 <= c.position <= 1 for c in r["copies"])
        taken[r["source"]] += r["taken"]
        seen.add(r["doc_id"])
    assert seen == set(size) and all(abs(taken[n] - want[n]) <= 200 for n in names)
    assert sorted(map(str, got)) == sorted(map(str, m.mix(make(rows[::-1]), m.rising).collect()))


def test_positions_follow_the_schedules(make):
    """By any time each source has been given about the words that the integral of its schedule asks for."""
    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(2000)]
    knots = [[(0.0, 2.0), (1.0, 0.0)], [(0.0, 0.0), (0.5, 1.0), (1.0, 1.0)]]
    at = defaultdict(list)
    for r in m.mix(make(rows), knots.__getitem__).collect():
        for c in r["copies"]:
            at[r["source"]].append((c.position, r["size"]))
    share = {"a": lambda t: 2 * t - t * t, "b": lambda t: (t * t if t < 0.5 else t - 0.25) / 0.75}
    for s, f in share.items():
        total = sum(w for _, w in at[s])
        for t in (0.1, 0.25, 0.5, 0.75, 0.9):
            assert sum(w for p, w in at[s] if p <= t) / total == pytest.approx(f(t), abs=0.01)


def test_demand_inverts():
    d = m.Demand([(0, 1), (0.3, 0), (0.6, 0), (1, 4)], 100)
    for t in (0.05, 0.2, 0.29, 0.7, 0.999):
        words = np.interp(0, [0], [0]) + sum((b - a) * (d_w(d, a) + d_w(d, b)) / 2 for a, b in zip(np.linspace(0, t, 20001)[:-1], np.linspace(0, t, 20001)[1:], strict=True))
        assert d.when(np.array([words]))[0] == pytest.approx(t, abs=1e-3)


def test_never_owed():
    d = m.Demand([(0, 1), (1, 1)], 10)
    assert d.when(np.array([0.0, 5.0, 10.0, 11.0])).tolist() == [0.0, 0.5, np.inf, np.inf]
    assert m.Demand([(0, 0), (1, 0)], 10).when(np.array([0.0])).tolist() == [np.inf]


def test_documents_come_by_position(make):
    rows = corpus(7, 200)
    df = m.by_position(m.mix(make(rows), m.rising))
    got = [r["position"] for r in df.collect()]  # partitions are collected in their order
    known = [p for p in got if p is not None]
    assert len(got) == len(rows) and known == sorted(known) and got[: len(known)] == known
    assert "rangepartitioning(position" in df._jdf.queryExecution().executedPlan().toString()


def d_w(d, t):
    return float(np.interp(t, d.t, d.w))


def test_targets_are_filled():
    got = m.targets([10, 1000, 50], [1, 1, 1], 1060, 3)
    assert got == pytest.approx([30, 880, 150]) and sum(got) == pytest.approx(1060)
    assert m.targets([10, 10], [1, 0], 20, 3) == [20, 0] and m.targets([1, 1], [1, 1], 20, 3) == [3, 3] and m.targets([], [], 0, 3) == []


def test_apply(make):
    rows = corpus(2, 100) + [(5, *corpus(2, 6)[5][1:])]
    mixed = m.mix(make(rows), m.rising)
    got = Counter(r["doc_id"] for r in m.apply(make(rows), mixed).collect())
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += len(r["copies"])
    assert got == +want and m.apply(make(rows), mixed).columns == make(rows).columns


@pytest.mark.parametrize("times", [2, 5])
def test_repeated_rows_share_their_copies(spark, make, times):
    """As many rows as the mix takes of all of them, where it takes some and not others; columns of any names."""
    rows = corpus(3, 40) * times
    df = make(rows).withColumnRenamed("key", "mix_id").withColumnRenamed("row", "mix_hash")
    mixed = m.mix(df, m.rising, budget_share=0.5)
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += len(r["copies"])
    got = m.apply(df, mixed)
    assert Counter(r["doc_id"] for r in got.collect()) == +want and got.columns == df.columns


def test_odd_rows(make, odd):
    got = m.mix(odd, m.rising).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    assert m.mix(make([]), m.rising).collect() == []
    assert all(r["taken"] == 0 for r in m.mix(make([(1, ""), (2, None)]), m.rising).collect())
