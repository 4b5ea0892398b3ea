"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows of items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words after lower-casing A-Z: digits, a-z and all bytes over 0x7F.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """All windows of some items in one automaton over numbered words; scans the words of a text once.

    A window is n consecutive words of an item, all its words if it has fewer. A node of the trie stands for a word in
    a window, so there are at most n nodes for each word of the items: about 0.5 KB for each, whatever the documents.
    """

    def __init__(self, items: Iterable[tuple[object, str | None]], n: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}  # from 1; 0 is any word that no item has
        place: dict[tuple, int] = {}
        self.items: list[list[str]] = []
        self.length: list[int] = []
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for i in range(max(1, len(words) - n + 1)) if words else ():
                w = tuple(words[i : i + n])
                k = place.setdefault(w, len(place))
                if k == len(self.items):
                    self.items.append([])
                    self.length.append(len(w))
                if item is not None and str(item) not in self.items[k][-1:]:
                    self.items[k].append(str(item))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for w, k in place.items():
            self.automaton.add_word(w, k)
        if place:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words [first, end) that windows cover, and the items with windows."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.length or not words:
            return spans, items
        number = self.numbers.get
        for last, k in self.automaton.iter(tuple([number(w, 0) for w in words])):
            first, end = last + 1 - self.length[k], last + 1
            items.update(self.items[k])
            if spans and first <= spans[-1][1]:
                # windows come by their ends; a longer one may begin before several earlier spans
                while len(spans) > 1 and first <= spans[-2][1]:
                    spans.pop()
                spans[-1] = (min(first, spans[-1][0]), end)
            else:
                spans.append((first, end))
        return spans, items


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in text of spans of words, from one pass over its bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [(m.start(), m.end()) for m in WORD.finditer(raw.translate(_TABLE))]
    # characters that begin before each byte
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[at[a][0]]), int(chars[at[b - 1][1]])) for a, b in spans]


def automaton(benchmark: DataFrame, n: int = 10, item_id: str = "item_id", text: str = "text"):
    """The automaton of all items, built once on the driver and broadcast: each Python worker of an executor loads it once.

    Test questions and answers don't grow with the corpus: some MB of text, half a GB of automaton for each million words.
    """
    spark = benchmark.sparkSession
    return spark.sparkContext.broadcast(Automaton(((r[0], r[1]) for r in benchmark.select(item_id, text).toLocalIterator()), n))


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all their columns as they are, in which no window of an item occurs (see scan)."""
    shared = automaton(benchmark, n, item_id, item_text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            yield b.filter(pa.array([not own.scan(words_of(t.as_py()))[0] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", offsets: bool = True) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit (words inside any occurrence of a window), items (ids of the
    items with windows in it, as sorted strings), spans (array of struct<start, end>: what is hit, as
    characters of the original text; null without ``offsets``).

    Lower-case and words are as in WORD; a window is n consecutive words of an item, an item of fewer words one
    window. Null or empty texts have no words; items without words have no windows; items without an id hit words
    but are in no list; repeated items count once, repeated documents are scanned each; other columns of either table are not read, whatever their names. One automaton holds
    all items, and each document is scanned whole, once.
    """
    shared = automaton(benchmark, n, item_id, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            count, hit, ids, where = [], [], [], []
            for t in b.column(1):
                t = t.as_py()
                words = words_of(t)
                spans, items = own.scan(words)
                count.append(len(words))
                hit.append(sum(y - x for x, y in spans))
                ids.append(sorted(items))
                where.append([{"start": x, "end": y} for x, y in original_spans(t, spans)] if spans and offsets else [] if offsets else None)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(count, pa.int64()), pa.array(hit, pa.int64()), pa.array(ids, pa.list_(pa.string())),
                pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start long, end long>>")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return scan(docs, benchmark, offsets=False).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[object, str | None]], n: int = 10) -> tuple[int, int, int, str]:
    """n_words, n_hit, n_items, items_sha256 by comparing each place with each window."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, ids = find(text), set(), set()
    for item, t in items:
        own = find(t)
        for w in {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else ():
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
     b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
     bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
            FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
     hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, s)),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
     ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
