import gzip
import io
import os
import struct
import zipfile

import pytest

from bazaar.llm import warc as m


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://h/{i} x", h, "extra") for i, h in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, monkeypatch, least):
    rows = [(5, "same"), (3, "same"), (9, None), (8, ""), (1, "<p>é\r\n\r\n</p>" * 500), (2, "longer text"), (4, "longer text"), (7, "longer text"), (6, "x")]
    got = {r["page_id"]: r for r in m.round_trip(spark, pages(spark, rows), least).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, html in rows:
        body = (html or "").encode()
        same = [k for k, h in rows if (h or "") == (html or "")]
        first = min(same) if len(body) >= least else i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(body), m.digest(body), "response" if first == i else "revisit", None if first == i else first)
        assert r["payload"] == (None if first != i else bytearray(body)) and r["url"] == f"http://h/{i}%20x"


def test_hot_payload_and_repeats(spark):
    rows = [(i, "hot") for i in range(600)] + [(1000, "once"), (1000, "once"), (None, "hot"), (None, "only")]
    got = m.round_trip(spark, pages(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(r["record_type"] == "response" for r in got) == 4
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {0}
    assert m.round_trip(spark, pages(spark, [])).collect() == []


def test_several_archives(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/a"
    base = pages(spark, [(i, os.urandom(3000).hex()) for i in range(50)]).repartition(3)
    manifest = m.write_archives(m.mark_revisits(base), path).collect()
    assert sum(r["records"] for r in manifest) == 50
    names = zipfile.ZipFile(manifest[0]["path"].removeprefix("file://"))
    assert names.testzip() is None and {i.compress_type for i in names.infolist()} == {zipfile.ZIP_STORED}
    monkeypatch.setattr(m, "READ_BYTES", 100)
    assert sum(1 for r in manifest for _ in m.archive_records(r["path"])) == 50


def test_long_page(spark):
    rows = [(1, "é<br>" * 2_000_000), (2, "x"), (3, "é<br>" * 2_000_000)]
    got = {r["page_id"]: r for r in m.round_trip(spark, pages(spark, rows)).collect()}
    body = rows[0][1].encode()
    assert got[1]["payload"] == body and (got[3]["payload_bytes"], got[3]["payload_digest"], got[3]["refers_to"]) == (len(body), m.digest(body), 1)


def foreign(folder, packed_index):
    """An archive as others write it: uuids as ids, two WARC members, text offsets, missing lengths and digests."""

    def member(*fields, block=b""):
        return gzip.compress("\r\n".join(["WARC/1.0", *fields]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    one = [
        member("WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:0>", "Content-Type: application/warc-fields", "Content-Length: 4", block=b"a: b"),
        member("WARC-Type: response", "WARC-Record-ID: <urn:uuid:1f>", "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + 5}", block=http + b"hello"),
        member("WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:2f>", "WARC-Target-URI: http://b/", "WARC-Refers-To: <urn:uuid:1f>", "WARC-Payload-Digest: sha1:" + m.digest(b"hello"), "Content-Type: application/http", f"Content-Length: {len(http)}", block=http),
    ]
    two = [member("WARC-Type: resource", "WARC-Record-ID: <urn:uuid:3f>", "WARC-Target-URI: urn:x", "WARC-Payload-Digest: sha256:00", block=b"plain\r\n\r\nbytes")]
    lines = ["!meta {}"]
    for name, parts in (("archive/a.warc.gz", one), ("b.warc.gz", two)):
        at = 0
        for p in parts:
            lines.append(f'com,a)/ 2020 {{"url": "u", "offset": "{at}", "length": "{len(p)}", "filename": "{name}"}}')
            at += len(p)
    index = "\n".join(lines).encode()
    path = folder / "other.wacz"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/a.warc.gz", b"".join(one))
        z.writestr("archive/b.warc.gz", b"".join(two))
        z.writestr("indexes/index.cdx.gz" if packed_index else "indexes/index.cdx", gzip.compress(index) if packed_index else index)
        z.writestr("indexes/index.idx", b"!meta")
        z.writestr("indexes/again.cdxj", index)
    return path


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others(spark, tmp_path, packed):
    path = foreign(tmp_path, packed)
    manifest = spark.createDataFrame([(f"file://{path}", path.stat().st_size, "x")], "path string, size long, payload string")
    got = {r["record_id"]: r for r in m.read_archives(manifest).collect()}
    assert sorted(got) == ["urn:uuid:0", "urn:uuid:1f", "urn:uuid:2f", "urn:uuid:3f"]
    a, b, c = (got[f"urn:uuid:{i}f"] for i in (1, 2, 3))
    assert (a["record_type"], a["payload"], a["payload_bytes"], a["payload_digest"], a["refers_to"]) == ("response", b"hello", 5, m.digest(b"hello"), None)
    assert (b["record_type"], b["payload"], b["payload_bytes"], b["payload_digest"], b["refers_to"]) == ("revisit", None, None, m.digest(b"hello"), "urn:uuid:1f")
    assert (c["record_type"], c["payload"], c["payload_digest"], c["url"]) == ("resource", b"plain\r\n\r\nbytes", "sha256:00", "urn:x")


def test_columns_of_any_names(spark):
    df = pages(spark, [(1, "a"), (2, "a")]).withColumnRenamed("payload", "_sha").withColumn("payload_key", m.F.lit(1))
    got = m.mark_revisits(df)
    assert got.columns == [*df.columns, "refers_to"] and sorted((r["page_id"], r["refers_to"], r["_sha"]) for r in got.collect()) == [(1, None, "extra"), (2, 1, "extra")]


def reader(data):
    return len(data), lambda offset, length: data[offset : offset + length]


def test_directories():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", b"one")
        z.writestr(zipfile.ZipInfo("b"), b"two" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"note PK\x05\x06 inside"
    size, read = reader(buffer.getvalue())
    a, b = m.zip_members(size, read)
    assert (a.name, read(m.data_at(a, read), a.size)) == ("a", b"one")
    with pytest.raises(ValueError, match="not stored"):
        m.data_at(b, read)
    for bad in (b"", b"junk" * 20, buffer.getvalue()[:-30]):
        with pytest.raises((ValueError, struct.error)):
            m.zip_members(*reader(bad))


def test_zip64_directory():
    """An archive whose end record and entries are all full, so that everything is in ZIP64 fields."""
    name, data, full = b"m", b"payload", 0xFFFFFFFF
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, full, full, 1, 20) + name + struct.pack("<HHQQ", 1, 16, 7, 7)
    pad = b"\0" * 100
    extra = struct.pack("<HH", 9, 2) + b"xx" + struct.pack("<HHQQQ", 1, 24, 7, 7, len(pad))
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, full, full, 1, len(extra), 0, 0, 0, 0, full) + name + extra
    at = len(pad) + len(local) + len(data)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, full, full, 0)
    size, read = reader(pad + local + data + entry + end64 + locator + end)
    (member,) = m.zip_members(size, read)
    assert (member.name, read(m.data_at(member, read), member.size)) == ("m", data)


def test_damage_is_seen():
    import zlib

    raw = zlib.decompress(m.record(1, "u", b"abc", None), 31).replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="damaged"):
        m.parse(z.compress(raw) + z.flush())


def test_a_column_refers_to_is_replaced(spark):
    pages = spark.createDataFrame([(1, "u", "x", 7), (2, "u", "x", 8)], "page_id long, url string, html string, refers_to long")
    assert sorted((r["page_id"], r["refers_to"]) for r in m.mark_revisits(pages).collect()) == [(1, None), (2, 1)]
