import hashlib
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from bazaar.llm import decontam, ngram_join, toxicity
from bazaar.llm.common import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(docs before, docs after) of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SF), name)
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontaminate", "mix", "shard"]
    for before, after in list(stages.values())[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()


def test_toxicity_stage(spark, stages, toxic_score):
    before, after = stages["toxicity"]
    model = toxicity.learn(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert texts(after) == {d: t for d, t in texts(before).items() if toxic_score(model, t) < toxicity.TOXIC}


def test_near_copies_stage(stages):
    before, after = stages["near_copies"]
    classes = ngram_join.brute_force(sorted(texts(before).items()))
    assert texts(after) == {d: t for d, t in texts(before).items() if classes[d][0] == d}


def test_decontamination_stage(spark, stages):
    before, after = stages["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert texts(after) == {d: t for d, t in texts(before).items() if not decontam.brute_force(t, items)[1]}


def curriculum(rows):
    """(position, doc_id) of each copy taken of (doc_id, text, source), by the definition: sources by code point, a cap of
    three times their words filled by weight, documents in the order of their ids' MD5, the time at which a source is owed
    more than the words up to a copy's middle by bisection of the integral."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    whole = {n: sum(size[d] for d, _, s in rows if s == n) for n in names}
    weight, target, left, open_ = {n: i % 3 + 1 for i, n in enumerate(names)}, {}, float(sum(whole.values())), set(names)
    while open_:
        unit = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if weight[n] * unit > 3 * whole[n]}
        for n in over or open_:
            target[n] = 3.0 * whole[n] if over else weight[n] * unit
        left -= sum(target[n] for n in over)
        open_ = open_ - over if over else set()
    out = []
    for i, n in enumerate(names):
        slope, begin = 0.5 if i % 2 else -0.5, 0
        owed = lambda t: target[n] * ((1 - slope) * t + slope * t * t)  # noqa: B023, E731
        for d in sorted((d for d, _, s in rows if s == n), key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d)):
            for k in range(3):
                words = k * whole[n] + begin + size[d] / 2
                if size[d] and words < target[n]:
                    lo, hi = 0.0, 1.0
                    for _ in range(60):
                        mid = (lo + hi) / 2
                        lo, hi = (mid, hi) if owed(mid) <= words else (lo, mid)
                    out.append((round(lo, 9), d))
            begin += size[d]
    return sorted(out)


def test_mix_and_shards(stages):
    before, after = stages["mix"]
    want = curriculum([(r["doc_id"], r["text"], r["source"]) for r in before.collect()])
    by_id = {r["doc_id"]: r for r in before.collect()}
    rows = after.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for _, d in want) and all(r == by_id[r["doc_id"]] for r in rows)
    # shards: the order of training cut where the middle of a document's bytes passes a 24th
    shards = sorted(stages["shard"][1].collect(), key=lambda r: (r["shard"], r["slot"]))
    size = {d: len((r["text"] or "").encode()) + 8 for d, r in by_id.items()}
    total, at, slots = sum(size[d] for _, d in want), 0, Counter()
    place = [d for _, d in want]
    assert sorted(place) == sorted(r["doc_id"] for r in shards)
    for r, d in zip(shards, place, strict=True):
        same = [x for p, x in want if p == want[slots.total()][0]]
        assert r["doc_id"] in same  # ties of position may stand in any order
        shard = min(int((at + size[r["doc_id"]] / 2) * 24 // total), 23)
        assert (r["size"], r["text_crc32"], r["shard"], r["slot"]) == (size[r["doc_id"]], zlib.crc32((by_id[r["doc_id"]]["text"] or "").encode()), shard, slots[shard])
        at += size[r["doc_id"]]
        slots[shard] += 1


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_and_nulls(spark, make, odd):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    extra = odd.select(*rows.columns)
    got = {n: None for n, _ in corpus_pipeline.STAGES}
    docs = staged(rows.unionByName(extra).unionByName(extra.limit(3)), "docs")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        got[name] = docs.count()
    kept = ngram_join.keep_one(odd).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "2", "3", "4", "None", "6", "7", "9"])
    assert all(got.values()) and ngram_join.keep_one(make([])).collect() == []
