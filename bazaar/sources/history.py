"""Channel histories as a streaming source: a file of JSON lines for each channel, in the order of message ids.

A channel is a partition with an offset of its own, the last message id that was handed on. Files grow at their end; a batch
reads what is past the offset, found by bisection, up to the last whole line that was there when the batch was planned.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from datetime import datetime

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructType, TimestampType

from bazaar.operators.ingest import FIRST_RUN, MESSAGE

log = logging.getLogger(__name__)
BLOCK = 1 << 16


def _id(line: bytes) -> int | None:
    """The message id of a line, None of a damaged one."""
    try:
        found = json.loads(line)["tg_msg_id"]
        return found if isinstance(found, int) else None
    except (ValueError, KeyError, TypeError):
        return None


class _File:
    """A history, on any storage that Arrow opens."""

    def __init__(self, path: str):
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.f = system.open_input_file(inner)
        self.size = self.f.size()

    def lines(self, start: int) -> Iterator[tuple[int, bytes]]:
        """(end, line) of whole lines from the first that begins at start or after."""
        self.f.seek(max(0, start - 1))
        at, rest, skip = max(0, start - 1), b"", start > 0
        while block := self.f.read(BLOCK):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                at += len(line) + 1
                if not skip:
                    yield at, line
                skip = False

    def last_id(self) -> int | None:
        """Of the last whole line that isn't damaged."""
        back = BLOCK
        while True:
            start = max(0, self.size - back)
            ids = [i for _, line in self.lines(start) if (i := _id(line)) is not None]
            if ids or not start:
                return ids[-1] if ids else None
            back *= 4

    def past(self, after: int) -> int:
        """A place before all lines with ids over after, and at most some blocks before them."""
        lo, hi = 0, self.size
        while hi - lo > BLOCK:
            mid = (lo + hi) // 2
            seen = next((i for _, line in self.lines(mid) if (i := _id(line)) is not None), None)
            lo, hi = (mid, hi) if seen is not None and seen <= after else (lo, mid)
        return lo


class Span(InputPartition):
    def __init__(self, channel: int, path: str, after: int, upto: int, fault: str | None = None):
        self.channel, self.path, self.after, self.upto, self.fault = channel, path, after, upto, fault


class HistoryReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"].rstrip("/"), schema
        self.limit = int(options.get("limit", FIRST_RUN))
        #: Where each channel stands: the cursors of the archive, then the offsets of batches.
        self.seen = {str(k): int(v or 0) for k, v in json.loads(options["cursors"]).items()}
        self.started = dict(self.seen)

    def _file(self, channel: str) -> str:
        return f"{self.path}/{channel}.jsonl"

    def initialOffset(self) -> dict:
        return {"upto": self.started, "faults": {}}

    def latestOffset(self) -> dict:
        upto, faults = dict(self.seen), {}
        for channel, after in self.seen.items():
            try:
                f = _File(self._file(channel))
                if after == 0:  # the oldest messages only
                    ids = (i for _, line in f.lines(0) if (i := _id(line)) is not None)
                    found = None
                    for _, found in zip(range(self.limit), ids, strict=False):
                        pass
                else:
                    found = f.last_id()
                upto[channel] = max(after, found or 0)
            except OSError as e:  # this channel stays where it is, the others go on
                log.exception("history of channel %s can't be read", channel)
                faults[channel] = type(e).__name__
        return {"upto": upto, "faults": faults}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for channel, upto in end["upto"].items():
            after = start["upto"].get(channel, 0)
            self.seen[channel] = max(self.seen.get(channel, 0), after, upto)
            if upto > after:
                out.append(Span(int(channel), self._file(channel), after, upto))
        return out + [Span(int(c), "", 0, 0, why) for c, why in end["faults"].items() if c not in start["faults"]]

    def read(self, partition: Span) -> Iterator[tuple]:
        names = [f.name for f in self.schema]
        fault = lambda why: tuple(partition.channel if n == "channel_id" else why if n == "fault" else None for n in names)
        if partition.fault:
            yield fault(partition.fault)
            return
        try:
            f = _File(partition.path)
            start = f.past(partition.after)
            last = 0 if start == 0 else None
            for _, line in f.lines(start):
                at = _id(line)
                if at is None:
                    if last is not None and last >= partition.after and line.strip():
                        yield fault("line: " + line[:80].decode("utf-8", "replace"))
                    continue
                last = at
                if partition.after < at <= partition.upto:
                    yield self._row(partition.channel, json.loads(line))
                if at >= partition.upto:
                    return
        except OSError as e:
            yield fault(type(e).__name__)

    def _row(self, channel: int, m: dict) -> tuple:
        out = []
        for f in self.schema:
            v = channel if f.name == "channel_id" else m.get(f.name)
            try:
                if v is not None and isinstance(f.dataType, TimestampType):
                    v = datetime.fromisoformat(v)
                elif v is not None:
                    v = int(v) if isinstance(f.dataType, LongType) else str(v)
            except (ValueError, TypeError):  # a field that isn't what it should be is missing
                v = None
            out.append(v)
        return tuple(out)


class ChannelHistory(DataSource):
    """format("channel_history"): options path (a folder of <channel id>.jsonl), cursors (JSON of channel id to the last id that is
    archived) and limit (how many messages of a channel without a cursor). Rows are messages, and for each damaged line and each
    channel that can't be read one with nothing but channel_id and fault."""

    @classmethod
    def name(cls) -> str:
        return "channel_history"

    def schema(self) -> str:
        return f"{MESSAGE}, fault string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return HistoryReader(self.options, schema)
