"""Perceptual hashes: 64 bits of the low frequencies of a 32 x 32 grey image, and distances between them."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

SIDE, LOW, SAME_IMAGE, FAR = 32, 8, 8, 64
#: Hashes of a part, about, of which two meet in a unit of work (an eighth where all are compared); up to so many bits pieces are looked up in tables.
PART, TABLES = 131_072, 11
#: Up to so many pairs of a unit are compared at once; pairs that are looked up are verified so many at a time.
FEW, MET = 100_000_000, 1_048_576

_k = np.arange(SIDE)
#: Orthonormal DCT-II.
DCT = np.sqrt(2 / SIDE) * np.cos(np.pi * np.outer(_k, 2 * _k + 1) / (2 * SIDE))
DCT[0] /= np.sqrt(2)


def hashes(pixels: np.ndarray) -> np.ndarray:
    """uint64 of each image of pixels (n, 32, 32): bit by bit, row after row, whether a frequency is over their median."""
    low = np.einsum("ij,njk,lk->nil", DCT[:LOW], pixels, DCT[:LOW]).reshape(len(pixels), LOW * LOW)
    bits = low > np.median(low, axis=1, keepdims=True)
    return np.packbits(bits, axis=1).view(">u8").ravel()


@F.arrow_udf(StringType())
def phash(pixels: pa.Array) -> pa.Array:
    """16 hex digits of array<double> of 1024 pixels, row by row; null for anything else."""
    rows = [p if p is not None and len(p) == SIDE * SIDE and None not in p else None for p in pixels.to_pylist()]
    good = [i for i, p in enumerate(rows) if p is not None]
    out: list = [None] * len(rows)
    if good:
        for i, h in zip(good, hashes(np.array([rows[i] for i in good], dtype=np.float64).reshape(-1, SIDE, SIDE)), strict=True):
            out[i] = f"{int(h):016x}"
    return pa.array(out, pa.string())


def grey(content: bytes) -> list[float] | None:
    """1024 grey values of an image file; None if it can't be read, or if no decoder (Pillow) is installed."""
    try:
        from PIL import Image
    except ImportError:
        return None
    try:
        with Image.open(io.BytesIO(content)) as image:
            small = image.convert("L").resize((SIDE, SIDE), Image.Resampling.LANCZOS)
            return [float(x) for x in small.tobytes()]
    except (OSError, ValueError):
        return None


def image_hashes(spark: SparkSession, path: str, decode: Callable[[bytes], list[float] | None] = grey) -> DataFrame:
    """(path, media_phash) of the files under path, from Spark's binaryFile source; null where ``decode`` finds no image.

    decode makes 1024 grey values, row by row, of a file's bytes.
    """

    @F.arrow_udf(ArrayType(DoubleType()))
    def pixels(content: pa.Array) -> pa.Array:
        return pa.array([None if c is None else decode(c) for c in content.to_pylist()], pa.list_(pa.float64()))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", phash(pixels("content")).alias("media_phash"))


def bits(hexa: Column) -> Column:
    """A hash as a long; null unless it is 1 to 16 hex digits."""
    return F.when(hexa.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(hexa, 16, -10).cast("long"))


def hamming_bits(left: Column, right: Column) -> Column:
    return F.coalesce(F.bit_count(left.bitwiseXOR(right)), F.lit(FAR))


def hamming(left: Column, right: Column) -> Column:
    """Bits that differ; 64 where either is missing or no hash."""
    return hamming_bits(bits(left), bits(right))


def pieces(distance: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of three pieces of a hash, four beyond 11 bits: hashes within the distance have one at
    least in which they differ by no more than its radius."""
    n = 3 if distance <= TABLES else 4
    edges = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo, (distance + 1 - i - 1) // n) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]


def _found(a: np.ndarray, b: np.ndarray, i: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places i of a, each with the ``count`` places of b from ``start`` on, a bounded number at a time."""
    total = np.cumsum(count)
    at = 0
    while at < len(i):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MET, "right")))
        some = count[at:end]
        yield a[np.repeat(i[at:end], some)], b[np.arange(int(some.sum())) + np.repeat(start[at:end] - np.cumsum(some) + some, some)]
        at = end


def _met(a: np.ndarray, b: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y): pairs of a and b within the distance, each once; both are hashes as uint64, each stands once in them.

    Few hashes, or a large distance, are compared all with all. Else every value around a piece is looked up in a table of b's.
    """
    if distance > TABLES or len(a) * len(b) <= FEW:
        rows = max(1, min(len(a), 65_536 // max(1, len(b))))
        apart, ones = np.empty((rows, len(b)), np.uint64), np.empty((rows, len(b)), np.uint8)
        for lo in range(0, len(a), rows):
            n = min(rows, len(a) - lo)
            np.bitwise_count(np.bitwise_xor(a[lo : lo + n, None], b[None, :], out=apart[:n]), out=ones[:n])
            met = np.flatnonzero(ones[:n] <= distance)
            if len(met):
                yield a[lo + met // len(b)], b[met % len(b)]
        return
    before: list[tuple[np.uint64, np.uint64, int]] = []
    for lo, n, radius in pieces(distance):
        shift, mask = np.uint64(lo), np.uint64((1 << n) - 1)
        left, right = ((h >> shift & mask).astype(np.int64) for h in (a, b))
        order = np.argsort(left, kind="stable")
        own, left = a[order], left[order]
        other = b[np.argsort(right, kind="stable")]
        begins = np.zeros((1 << n) + 1, np.int64)
        np.cumsum(np.bincount(right, minlength=1 << n), out=begins[1:])
        for turned in _masks(n, radius):
            near = left ^ turned
            start = begins[near]
            count = begins[near + 1] - start
            i = np.flatnonzero(count)
            for x, y in _found(own, other, i, start[i], count[i]):
                apart = x ^ y
                good = np.bitwise_count(apart) <= distance
                for s, m, r in before:  # pairs that an earlier piece has found
                    good &= np.bitwise_count(apart >> s & m) > r
                if good.any():
                    yield x[good], y[good]
        before.append((shift, mask, radius))


def _masks(bits_: int, radius: int) -> list[int]:
    return [sum(1 << i for i in some) for r in range(radius + 1) for some in combinations(range(bits_), r)]


def near_pairs(hashes: DataFrame, value: str, distance: int = SAME_IMAGE, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, y, distance): pairs x < y of different hashes (longs) within the distance, each once, of equal ``by``.

    The hashes of a ``by`` are dealt to parts of bounded size, packed, and every two parts meet in a unit. There a hash looks up,
    of its three long pieces, all values within a radius (multi-index hashing); beyond TABLES bits all are compared.
    """
    known = hashes.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("long").alias("v")).distinct()
    parts = F.ceil(F.count("*") / F.lit(PART if distance <= TABLES else PART // 8)).cast("int").alias("__parts")
    sizes = known.groupBy(*by).agg(parts)
    dealt = known.join(sizes, [*by]) if by else known.crossJoin(F.broadcast(sizes))
    packed = dealt.withColumn("__part", F.pmod(F.xxhash64("v"), F.col("__parts")).cast("int")).groupBy(*by, "__parts", "__part").agg(F.collect_list("v").alias("vs"))
    met = packed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    units = met.select(*by, F.least("__part", "__other").alias("__low"), F.greatest("__part", "__other").alias("__high"), "__part", "vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b.slice(i, 1) for b in batches for i in range(b.num_rows)]
        sides = [r.column("vs")[0].values.to_numpy().view(np.uint64) for r in rows]
        alone = len(sides) == 1
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            x, y = (np.concatenate(side) for side in zip(*held, strict=True))
            held.clear()
            keys = [pa.array([rows[0].column(c)[0].as_py()] * len(x), rows[0].column(c).type) for c in by]
            values = (np.minimum(x, y), np.maximum(x, y), np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64))
            return pa.RecordBatch.from_arrays([*keys, *map(pa.array, values)], names=[*by, "x", "y", "distance"])

        for x, y in _met(sides[0], sides[-1], distance):
            x, y = x.view(np.int64), y.view(np.int64)
            if alone:  # each pair is met from both sides, and each hash meets itself
                x, y = x[x < y], y[x < y]
            held.append((x, y))
            if len(held) == 1024 or len(x) > 16_384:
                yield out()
        if held:
            yield out()

    kinds = dict(known.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "x long, y long, distance long"])
    return units.groupBy(*by, "__low", "__high").applyInArrow(run, schema)
