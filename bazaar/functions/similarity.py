"""Token-set similarity of texts, 0 to 100, by longest common subsequences of characters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(left: str | None, right: str | None) -> float:
    """100 where one side's words hold the other's; else the best match among the common words, and the common words
    with those of either side, as 100 * (1 - insertions and deletions / lengths). 0 if a side has no words."""
    a, b = set((left or "").split()), set((right or "").split())
    if not a or not b:
        return 0.0
    both = a & b
    if both and (a <= b or b <= a):
        return 100.0
    only = [" ".join(sorted(x - both)) for x in (a, b)]
    common = len(" ".join(sorted(both)))
    glue = 1 if common else 0
    sizes = [common + glue + len(x) for x in only]
    edits = len(only[0]) + len(only[1]) - 2 * lcs(*only)
    best = 100 * (1 - edits / (sizes[0] + sizes[1]))
    if common:
        for x, size in zip(only, sizes, strict=True):
            best = max(best, 100 * (1 - (glue + len(x)) / (common + size)))
    return best


@F.arrow_udf(DoubleType())
def token_set_ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([ratio(a, b) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())
