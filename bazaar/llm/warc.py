"""WARC records in ZIP archives: a writer, and a reader that never extracts.

An archive holds two kinds of stored (uncompressed) members: ``archive/*.warc.gz``, one gzip member for
each record, and ``indexes/``, with a line of JSON for each record with its offset and length in a WARC member.
The reader takes only ranges: the end of the file, the central directory, local headers, an index, records. It reads
archives of other writers too: record ids are text, numbers in indexes may be, indexes may be packed, and what a
record's header lacks is taken from its payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import free, lookup, new_dir, staged

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed beyond so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Neighbouring records are read together up to so many bytes.
READ_BYTES = 4 << 20
#: Bytes of archives that a task reads, about, where there are more than tasks that Spark is set to have.
TASK_BYTES = 512 << 20


# --- ZIP directory -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


def zip_members(size: int, read: Callable[[int, int], bytes]) -> list[Member]:
    """Members of a ZIP file of ``size`` bytes, from its central directory; read(offset, length) gives a range.

    ZIP64 end records and extra fields are followed where a 16- or 32-bit field is full. Raises ValueError
    where there is no end record or the directory is cut short.
    """
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (length, start):
        locator = read(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, members, p = read(start, length), [], 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("central directory cut short")
        method, packed, full, n_name, n_extra, n_note = struct.unpack_from("<H8xIIHHH", directory, p + 10)
        header_at = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # the fields that are full, in this order
                r = q + 4
                if full == 0xFFFFFFFF:
                    full, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                if packed == 0xFFFFFFFF:
                    packed, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                if header_at == 0xFFFFFFFF:
                    header_at = struct.unpack_from("<Q", extra, r)[0]
            q += 4 + n
        members.append(Member(name, method, packed, header_at))
        p += 46 + n_name + n_extra + n_note
    return members


def data_at(member: Member, read: Callable[[int, int], bytes]) -> int:
    """Where a stored member's bytes begin; ValueError if it is compressed."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = read(member.header_at, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))


# --- records -------------------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or revisit where refers_to is given, as one gzip member."""
    block = HTTP if refers_to is not None else HTTP + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {target}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(packed: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-cased name, payload) of one gzip member; ValueError if a length or digest doesn't fit.

    The payload of an HTTP block is what follows its header, of any other block all of it. Without Content-Length the
    block is all but the line ends that close a record. A digest is checked where it is SHA-1 in base 32.
    """
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = fields.get("content-length")
    block = rest[: int(size)] if size else rest.removesuffix(b"\r\n\r\n")
    if size and len(block) < int(size):
        raise ValueError(f"{fields.get('warc-record-id')} is cut short")
    http = fields.get("content-type", "").startswith("application/http") or (fields.get("warc-type") in ("response", "revisit") and block.startswith(b"HTTP/"))
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    said = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "response" and said.startswith("sha1:") and len(said) == 37 and said[5:].upper() != digest(payload):
        raise ValueError(f"payload of {fields.get('warc-record-id')} is damaged")
    return fields, payload


def index_entries(data: bytes) -> Iterator[dict]:
    """Entries of an index with ``filename``, ``offset`` and ``length`` as numbers; lines without JSON are left out. Packed
    (gzip, of one member or more) or not."""
    text = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    for line in text.decode("utf-8", "replace").splitlines():
        at = line.find("{")
        if at >= 0 and not line.startswith("!"):
            e = json.loads(line[at:])
            if "offset" in e and "length" in e:
                yield {"filename": e.get("filename", ""), "offset": int(e["offset"]), "length": int(e["length"])}


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", refers_to: str = "refers_to") -> DataFrame:
    """Writes pages as archives under path; gives (path, size, records), a row for each archive.

    Each attempt of a task writes files of its own names, and only those in the result count, so a lost
    executor or a second attempt leaves no record twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _open(path)
        store.create_dir(root, recursive=True)
        k, zipped, stream, body, index, at, done = 0, None, None, None, [], 0, []

        def close() -> None:
            nonlocal zipped
            body.close()
            with zipped.open(zipfile.ZipInfo("indexes/index.cdxj"), "w", force_zip64=True) as f:
                f.write("".join(index).encode())
            zipped.close()
            stream.close()
            done.append((name, store.get_file_info(f"{root}/{name}").size, len(index)))
            zipped = None

        for b in batches:
            for page, address, text, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if zipped is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{k}.wacz"
                    k, index, at = k + 1, [], 0
                    stream = store.open_output_stream(f"{root}/{name}")
                    zipped = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    body = zipped.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True)
                packed = record(page, address, (text or "").encode(), refers)
                body.write(packed)
                index.append(f"{page} 20000101000000 {json.dumps({'offset': at, 'length': len(packed), 'filename': 'data.warc.gz'})}\n")
                at += len(packed)
                if at >= ARCHIVE_BYTES:
                    close()
        if zipped is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{n}" for n, _, _ in done], pa.string()), pa.array([s for _, s, _ in done], pa.int64()), pa.array([c for _, _, c in done], pa.int64())], names=["path", "size", "records"])

    return pages.select(page_id, url, html, refers_to).mapInArrow(write, "path string, size long, records long")


def archive_records(path: str, size: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each indexed record of one archive, by range reads, in the index's order.

    A file name in an index is the member's whole name or its last part; if the archive has one WARC member only, that
    is meant whatever the name. Entries that stand in several indexes are read once.
    """
    store, at = _open(path)
    with store.open_input_file(at) as f:
        size = f.size() if size is None else size
        read = lambda offset, length: f.read_at(length, offset)
        members = zip_members(size, read)
        warcs = [m for m in members if m.name.endswith((".warc.gz", ".warc"))]
        named = {m.name.rpartition("/")[2]: m for m in warcs} | {m.name: m for m in warcs} | {m.name.removeprefix("archive/"): m for m in warcs}
        begins: dict[str, int] = {}

        def begin(name: str) -> int:
            m = warcs[0] if len(warcs) == 1 else named[name]
            if m.name not in begins:
                begins[m.name] = data_at(m, read)
            return begins[m.name]

        seen: set[int] = set()
        for m in sorted((m for m in members if m.name.startswith("indexes/") and not m.name.endswith((".idx", "/"))), key=lambda m: m.name):
            entries = [(begin(e["filename"]) + e["offset"], e["length"]) for e in index_entries(read(data_at(m, read), m.size))]
            entries = [e for e in dict.fromkeys(entries) if e[0] not in seen]
            seen.update(e[0] for e in entries)
            i = 0
            while i < len(entries):
                j, start = i, entries[i][0]
                end = start
                while j < len(entries) and entries[j][0] == end and (j == i or end - start < READ_BYTES):
                    end, j = end + entries[j][1], j + 1
                part = read(start, end - start)
                for offset, length in entries[i:j]:
                    yield parse(part[offset - start : offset - start + length])
                i = j


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in manifest (path, size): record_id (text, without brackets), url, payload_bytes,
    payload_digest, record_type, refers_to (a record_id), and the payload (null for revisits) where asked for.

    payload_bytes and payload_digest are of the full payload: for revisits what their header says, null if it doesn't;
    for others the header's digest, else that of the payload. Archives of several tasks' bytes are read in parallel, one
    archive by one task. Other columns of manifest are not read.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for h, payload in archive_records(path, size):
                    kind = h.get("warc-type", "")
                    revisit = kind == "revisit"
                    length = h.get("x-payload-length") if revisit else len(payload)
                    said = h.get("warc-payload-digest") or (None if revisit else f"sha1:{digest(payload)}")
                    ids = [(h.get(k) or "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to")]
                    rows.append((ids[0], h.get("warc-target-uri"), None if length is None else int(length), said and said.removeprefix("sha1:"), kind, ids[1], payload if payloads and not revisit else None))
                    held += len(payload)
                    if held > READ_BYTES or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    n, size = manifest.agg(F.count("*"), F.sum("size")).first()
    tasks = max(1, min(n, max(4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // TASK_BYTES)))
    return manifest.select("path", "size").repartition(tasks).mapInArrow(load, "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def mark_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """pages plus ``refers_to``: the smallest page_id of those with an equal payload, null for that page itself.

    Payloads are equal where SHA-1 and length are. Payloads under min_bytes are never revisits. A null payload is
    empty. A repeated page_id with an equal payload is a response each time; a null page_id revisits if another
    page has the payload. Other columns stay, whatever their names, but one named refers_to is replaced.
    """
    pages = pages.drop("refers_to")
    body = F.coalesce(F.col(html), F.lit(""))
    sha = F.concat(F.sha1(body.cast("binary")), F.lit(":"), F.octet_length(body).cast("string"))
    slim = staged(pages.select(F.col(page_id).alias("_id"), sha.alias("_sha"), F.octet_length(body).alias("_n")), "payloads")
    groups = slim.filter(F.col("_n") >= min_bytes).groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1 and _first is not null")
    again = lookup(slim.select("_id", "_sha"), staged(groups, "payload-groups"), "_sha", "_rows").filter(~F.col("_id").eqNullSafe(F.col("_first"))).distinct()
    key_, id_, sha_ = free(pages, "payload_key", "revisit_id", "revisit_key")
    again = again.select(F.col("_id").alias(id_), F.col("_sha").alias(sha_), F.col("_first").alias("refers_to"))
    return pages.withColumn(key_, sha).join(again, F.col(page_id).eqNullSafe(F.col(id_)) & (F.col(key_) == F.col(sha_)), "left").drop(key_, id_, sha_)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in the shared folder and reads them back: read_archives with page_id
    and refers_to as the numbers that the writer put into the record ids."""
    pages = pages.select("page_id", "url", "html")
    manifest = staged(write_archives(mark_revisits(pages, min_bytes=min_bytes), new_dir(spark, "warc")), "manifest")
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    return read_archives(manifest).withColumns({"page_id": number("record_id"), "refers_to": number("refers_to")})


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     s AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex, html FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM s),
     bits AS (SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(hex, 5 * g + 1, 5))::BIGINT) AS quint FROM f)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((quint[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM bits
"""
