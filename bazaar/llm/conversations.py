"""Conversation structure repair: the cheapest edits that make the roles of a conversation (s?(ua)+)?, by forward Viterbi.

States of the grammar: START (nothing yet), SYSTEM (one system turn), USER (a user turn waits for its answer) and
ANSWERED. A conversation may end in START or ANSWERED. Each row is kept (0), given another role (3) or deleted (4; what
is blank or a duplicate must be), an undeleted row that is cut off costs 3 more, and empty turns may be inserted
anywhere (3). A state carries the least (cost, audit), the audit being the edits' initials in order; after each row,
inserted turns close the layer: two of them reach every state that they can, so more never pay.

Of two audits of one layer and cost none begins the other (what follows would be insertions, which cost), so the least
audit stays the least whatever comes after, and the grammar says which role each letter stands for: an audit decides
the result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.sharding import _BYTE_CRC

START, SYSTEM, USER, ANSWERED = range(4)
#: Where the initial of a role leads, from each state.
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ANSWERED}, {"u": USER}]
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Rows after which what the states' audits have in common is put aside.
OFTEN = 64
_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_END = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
_LEGAL = {"su", "ua", "au"}


class Path:
    """The cheapest way to a state: its cost, the audit since what was put aside, the digest of the turns so far."""

    __slots__ = ("cost", "audit", "sha", "any")

    def __init__(self, cost: int, audit: str, sha, any_: bool):
        self.cost, self.audit, self.sha, self.any = cost, audit, sha, any_

    def then(self, cost: int, letter: str, turn: str | None = None) -> Path:
        if turn is None:
            return Path(self.cost + cost, self.audit + letter, self.sha, self.any)
        sha = self.sha.copy()
        sha.update((f"\n{turn}" if self.any else turn).encode("utf-8", "surrogatepass"))
        return Path(self.cost + cost, self.audit + letter, sha, True)


def fault(text: str, again: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated or none."""
    return "blank" if not _SEEN.search(text) else "duplicate" if again else "" if _END.search(text) else "truncated"


class Repair:
    """Takes the rows of a conversation one by one; holds four paths, whatever their number."""

    def __init__(self):
        self.done: list[str] = []
        self.rows = self.illegal = self.turns = 0
        self.first = self.last = None
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.before: str | None = None
        self.paths: list[Path | None] = [Path(0, "", hashlib.sha256(), False), None, None, None]
        self._close()

    def _best(self, options: dict[int, list[tuple]]) -> None:
        """options: by state, (path before, cost, letter, turn) of each way to it."""
        self.paths = [None] * 4
        for state, ways in options.items():
            p, cost, letter, turn = min(ways, key=lambda w: (w[0].cost + w[1], w[0].audit + w[2]))
            self.paths[state] = p.then(cost, letter, turn)

    def _close(self) -> None:
        """Inserted turns: a user turn into USER, then an answer into ANSWERED."""
        for state, letter, sources in ((USER, "u", (START, SYSTEM, ANSWERED)), (ANSWERED, "a", (USER,))):
            ways = [(p.cost + INSERT, p.audit + "I", p) for s in sources if (p := self.paths[s])]
            own = self.paths[state]
            best = min(ways, key=lambda w: w[:2], default=None)
            if best and (own is None or best[:2] < (own.cost, own.audit)):
                self.paths[state] = best[2].then(INSERT, "I", f"{ROLES[letter]}:")

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        self.rows += 1
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.before is not None and self.before[:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        self.before = role
        what = fault(text, again)
        if what:
            self.faults[what] += 1
        ways: dict[int, list[tuple]] = {}
        extra = CUT if what == "truncated" else 0
        for state, p in enumerate(self.paths):
            if p is None:
                continue
            ways.setdefault(state, []).append((p, DELETE, "D", None))
            if what in ("", "truncated"):
                if (to := NEXT[state].get(role[:1])) is not None:
                    ways.setdefault(to, []).append((p, extra, "K", f"{role}:{text}"))
                for r, name in ROLES.items():
                    if (to := NEXT[state].get(r)) is not None:
                        ways.setdefault(to, []).append((p, REROLE + extra, "R", f"{name}:{text}"))
        self._best(ways)
        self._close()
        if self.rows % OFTEN == 0:
            self._settle()

    def _settle(self) -> None:
        """Ends ways that no ending can make the cheapest, and puts the common beginning of the audits aside.

        Whatever follows START, ANSWERED can do for 4 more (it must delete a system turn at most), and what follows
        SYSTEM for nothing.
        """
        start, system, _, answered = self.paths
        if answered and start and start.cost > answered.cost + DELETE:
            self.paths[START] = None
        if answered and system and (system.cost, system.audit) > (answered.cost, answered.audit):
            self.paths[SYSTEM] = None
        left = [p for p in self.paths if p]
        common = os.path.commonprefix([p.audit for p in left])
        if common:
            self.done.append(common)
            for p in {id(p): p for p in left}.values():
                p.audit = p.audit[len(common) :]

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
        best = min((p for p in (self.paths[START], self.paths[ANSWERED]) if p), key=lambda p: (p.cost, p.audit)) if self.rows else Path(0, "", hashlib.sha256(), False)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, best.cost, "".join(self.done) + best.audit, best.sha.hexdigest()


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _ordered(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Each conversation in one task, sorted: notes about it first (kind 0), then its rows in order."""
    told = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    both = told if more is None else told.unionByName(more)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text")


def _named(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))


def _key(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).hexdigest()


def repair(rows: DataFrame, ids: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: conv_id, gaps (turn numbers that are missing between the first and the last), blank,
    duplicate, truncated (rows by their first fault), illegal (neighbours that the grammar forbids), cost, audit
    (initials of Keep, Rerole, Delete, Insert, in order) and repaired_sha256 (of the repaired ``role:text``, joined by
    newlines; see turns for the turns themselves).

    Rows stand in the order of turn, null first, ties by role and text in the order of their bytes. A null role or text
    is one space; roles are known by their initials; a duplicate is a row whose role and text an earlier row has.
    Repeated rows are duplicates. ids: a table of conversations that are to be in the result though they may have
    no rows (zeros, an empty audit, the digest of nothing); a null id is a conversation as well. Other columns are not
    read, whatever their names. A conversation is streamed through one task, as audit and digest are one value
    each; of it the task holds four paths, and a digest for each text that the conversation repeats.
    """
    kind = dict(rows.dtypes)[conv_id]
    rows = _named(rows, conv_id, turn, role, text)
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    again = rows.groupBy("conv_id", key.alias("role")).count().where("count > 1").select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), "role", F.lit("").alias("text"))
    if ids is not None:
        known = ids.select(F.col(conv_id).cast(kind).alias("conv_id")).distinct()
        again = again.unionByName(known.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, seen, out = None, None, {}, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [b.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", *COLUMNS])

        for b in batches:
            for conv, note, at, who, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != last:
                    if state is not None:
                        out.append((last, *state.result()))
                    last, state, seen = conv, Repair(), {}
                if note == 0:
                    seen[who] = False
                    continue
                k = _key(who, said) if seen else None
                state.add(at, who, said, seen.get(k, False))
                if k in seen:
                    seen[k] = True
            if out:
                yield flush()
                out = []
        if state is not None:
            out.append((last, *state.result()))
            yield flush()

    fields = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in COLUMNS)
    return _ordered(rows, again).mapInArrow(run, f"conv_id {kind}, {fields}")


def turns(rows: DataFrame, repaired: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I); deleted rows are gone.

    repaired: what repair made of these rows. A conversation streams through one task, which holds its audit.
    """
    kind = dict(rows.dtypes)[conv_id]
    rows = _named(rows, conv_id, turn, role, text)
    notes = repaired.select(F.col("conv_id"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"), F.lit("").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, audit, at, place, state, begun, names = None, "", 0, 0, START, False, {v: k for k, v in ROLES.items()}
        out: list[tuple] = []

        def put(edit: str, who: str, said: str) -> None:
            nonlocal place, state
            own = who if edit == "K" else ROLES["a" if state == USER else "u"]
            out.append((last, place, own, said, edit))
            place, state = place + 1, NEXT[state][names.get(own, own[:1])]

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", "", "")
                at += 1

        for b in batches:
            types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            for conv, note, _, who, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or conv != last:
                    inserted()
                    last, audit, at, place, state, begun = conv, "", 0, 0, START, True
                if note == 0:
                    audit = who
                    continue
                inserted()
                if audit[at] != "D":
                    put(audit[at], who, said)
                at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "place", "role", "text", "edit"])
                out = []
        inserted()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "place", "role", "text", "edit"])

    return _ordered(rows, notes).mapInArrow(run, f"conv_id {kind}, place long, role string, text string, edit string")


def damage(rows: DataFrame) -> DataFrame:
    """conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops a row, 1
    empties its text, 2 takes its marks of an end, 3 repeats it, 4 makes its role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    said = F.when(h == 1, "").when(h == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(blank("role")).alias("role"), said.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damage(rows), rows)


def _ways(*ways: tuple[str, str, str, str, str]) -> str:
    """The least of (from, cost, letter, turn, condition), as SQL; a way that isn't there is null."""
    one = "CASE WHEN {0} IS NOT NULL AND {4} THEN {{'c': {0}.c + {1}, 'a': {0}.a || '{2}', 'r': " + "CASE WHEN '{2}' = 'D' THEN {0}.r WHEN {0}.r = '' THEN {3} ELSE {0}.r || chr(10) || {3} END}} END"
    return f"list_sort(list_filter([{', '.join(one.format(*w) if w[1] else w[0] for w in ways)}], lambda w: w IS NOT NULL))[1]"


_KEPT, _USER, _ANSWER = "role || ':' || text", "'user:' || text", "'assistant:' || text"
_FREE = "fault IN ('', 't')"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
_drop = lambda s: (s, "4", "D", "''", "true")
_keep = lambda s, r: (s, "e", "K", _KEPT, f"{_FREE} AND left(role, 1) = '{r}'")
_role = lambda s, turn: (s, "(3 + e)", "R", turn, _FREE)
_put = lambda s, turn: (s, "3", "I", f"'{turn}'", "true")
OP13_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, {_BYTE_CRC} AS c FROM range(0, 256) r(i))),
     c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
     h AS (SELECT c.*, {_CRC} % 20 AS h FROM c, crc),
     d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                  unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
     o AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
     m AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN '' ELSE 't' END AS fault
           FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen FROM o)),
     walk AS (
       SELECT DISTINCT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': '', 'r': ''}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS s1,
              {{'c': 3, 'a': 'I', 'r': 'user:'}} AS s2, {{'c': 6, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}} AS s3 FROM m
       UNION ALL
       SELECT conv_id, n, t0, t1, u2, {_ways(("t3", "", "", "", ""), _put("u2", "assistant:"))} FROM (
         SELECT *, {_ways(("t2", "", "", "", ""), *(_put(s, "user:") for s in ("t0", "t1", "t3")))} AS u2 FROM (
           SELECT conv_id, n, {_ways(_drop("s0"))} AS t0, {_ways(_drop("s1"), _keep("s0", "s"))} AS t1,
                  {_ways(_drop("s2"), *(_keep(s, "u") for s in ("s0", "s1", "s3")), *(_role(s, _USER) for s in ("s0", "s1", "s3")))} AS t2,
                  {_ways(_drop("s3"), _keep("s2", "a"), _role("s2", _ANSWER))} AS t3
           FROM (SELECT walk.conv_id, m.n, s0, s1, s2, s3, role, text, fault, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS e FROM walk JOIN m ON walk.conv_id IS NOT DISTINCT FROM m.conv_id AND m.n = walk.n + 1)))),
     facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                      count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
     best AS (SELECT conv_id, n, {_ways(("s0", "", "", "", ""), ("s3", "", "", "", ""))} AS s FROM walk),
     ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.c, 0)::BIGINT AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(s.r, '')) AS repaired_sha256
FROM ids LEFT JOIN facts ON ids.conv_id IS NOT DISTINCT FROM facts.conv_id LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id AND best.n = facts.n
"""
