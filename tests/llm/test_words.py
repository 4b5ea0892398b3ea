import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bazaar.llm import words as m


def texts(seed):
    rng = random.Random(seed)
    alphabet = ["a", "b", "é", "中", "Z", "7", " ", "\n", "\t", "-", ".", "\x1c"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(200)] + ["", None, "x" * 5000, " ", None]


@pytest.mark.parametrize(("sep", "pattern"), [(m.SPACE, rb"[^\x20\x09-\x0D]+"), (m.NOT_ALNUM, rb"[0-9A-Za-z\x80-\xff]+")])
def test_spans_and_hashes(monkeypatch, sep, pattern):
    monkeypatch.setattr(m, "CHUNK", 300)
    given = texts(1)
    got, of = [[] for _ in given], {}
    for lo, hi, raw, offsets in m.chunks(pa.array(given)):
        row, start, end = m.spans(raw, offsets, sep)
        assert row.max(initial=0) < hi - lo
        for r, s, e, h in zip(row, start, end, m.hashes(raw, start, end), strict=True):
            word = raw[s:e].tobytes()
            got[lo + r].append(word)
            assert of.setdefault(word, h) == h
    assert got == [re.findall(pattern, (t or "").encode()) for t in given]
    assert len(set(of.values())) == len(of)


def test_grams():
    row = np.array([0, 0, 0, 2, 2, 2, 2])
    h = np.array([5, 6, 7, 5, 6, 7, 9], dtype=np.uint64)
    at, g = m.grams(h, row, 3)
    assert at.tolist() == [0, 3, 4] and g[0] == g[1] != g[2]
    assert len(m.grams(h[:2], row[:2], 3)[0]) == 0


def test_index():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    index = m.Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1)) == [np.searchsorted(keys, k + 1) if k + 1 in set(keys.tolist()) else -1 for k in keys.tolist()]).all()
    assert m.Index(np.zeros(0, np.uint64)).find(keys[:3]).tolist() == [-1] * 3


class _Session:
    """What shared_dir sees of a session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.sparkContext, self.conf, self.master, self.folder = self, self, master, None

    def get(self, name, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_dir_without_a_setting():
    from bazaar.llm.common import shared_dir

    local = _Session("local[2]")
    found = shared_dir(local)
    assert found == local.folder == shared_dir(local)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(_Session("spark://cluster:7077"))
