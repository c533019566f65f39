"""ZIP-packaged WARC archives: round trips, Python's own ZIP reader, brute force."""

import base64
import glob
import gzip
import hashlib
import io
import json
import struct
import zipfile

import pytest
import zstandard

from tonemill.llm import warc_zip
from tonemill.session import scratch_path

F = warc_zip.F


def digest(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def brute(pages, least=0):
    """Expected (page id, bytes, digest, type, refers to) of (id, payload) rows."""
    first = {}
    for i, html in pages:
        raw = (html or "").encode()
        key = (i is None, i)
        if len(raw) >= least and (raw not in first or key < first[raw]):
            first[raw] = key
    out, used = [], set()
    for i, html in pages:
        raw = (html or "").encode()
        key = (i is None, i)
        response = len(raw) < least or key == first[raw] and raw not in used
        if key == first.get(raw):
            used.add(raw)
        out.append((i, len(raw), digest(raw), "response" if response else "revisit", None if response else first[raw][1]))
    return sorted(out, key=repr)


def round_trip(spark, pages, least=0, schema="page_id long, html string, url string, digest int, row string"):
    path = scratch_path(spark, "test")
    df = spark.createDataFrame([(i, h, f"http://a b.example/{i}\r\n?x=ä", 1, "clash") for i, h in pages], schema)
    warc_zip.write_archives(df, path, least_bytes=least)
    return path, warc_zip.read_archives(spark, path)


def rows(out):
    name = lambda c: warc_zip.page_name(F.col(c)).cast("long")
    return sorted(map(tuple, out.select(name("record_id"), "payload_bytes", "payload_digest", "record_type", name("refers_to")).collect()), key=repr)


PAGES = [(i, f"<p>{i % 7} größe 漢字 PK\x05\x06 \r\n\r\n</p>") for i in range(60)] + [(100, None), (101, ""), (102, "x" * 300_000), (3, "own"), (3, "own"), (3, "other"), (None, "own"), (None, "lost"), (None, "lost")]


@pytest.mark.parametrize("least", [0, 40, 10**9])
def test_round_trip(spark, least):
    path, out = round_trip(spark, PAGES, least)
    assert rows(out) == brute(PAGES, least)
    payloads = {(r.payload_digest, bytes(r.payload).decode()) for r in out.where("record_type = 'response'").collect()}
    assert payloads == {(digest((h or "").encode()), h or "") for _, h in PAGES}
    assert {r.digest_ok for r in out.collect()} <= {"yes", "unknown"}


def test_written_files_are_plain_zips(spark):
    path, out = round_trip(spark, PAGES)
    n = 0
    for name in glob.glob(f"{path.removeprefix('file:')}/part-*"):
        with zipfile.ZipFile(name) as z:
            assert z.testzip() is None and {m.compress_type for m in z.infolist()} == {zipfile.ZIP_STORED}
            for index in (m for m in z.namelist() if m.startswith("indexes/")):
                archive = z.read(index.replace("indexes", "archive").replace("cdxj", "warc.zst"))
                lines = [json.loads(x[x.index("{"):]) for x in z.read(index).decode().splitlines()]
                records = [zstandard.decompress(archive[e["offset"]:e["offset"] + e["length"]], max_output_size=1 << 20) for e in lines]
                whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(archive), read_across_frames=True).read()
                assert len(whole) == sum(map(len, records)) and all(r in whole for r in records)
                assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
                n += len(records)
    assert n == len(PAGES)


def test_many_members_groups_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "MEMBER_RECORDS", 3)
    monkeypatch.setattr(warc_zip, "BROADCAST_GROUPS", 1)
    monkeypatch.setattr(warc_zip, "RANGE_BYTES", 2000)
    path, out = round_trip(spark, PAGES)
    assert rows(out) == brute(PAGES)


def test_empty_table(spark):
    path, out = round_trip(spark, [])
    assert out.collect() == []


def test_uris_are_escaped(spark):
    _, out = round_trip(spark, [(1, "a")])
    assert out.first().target_uri == "http://a%20b.example/1%0D%0A?x=%C3%A4"


def foreign(records, suffix, method=zipfile.ZIP_STORED):
    """A ZIP made by Python's writer (no ZIP64 unless it must)."""
    pack = {".warc": bytes, ".warc.gz": gzip.compress, ".warc.zst": zstandard.compress}[suffix]
    body, lines = b"", []
    for raw in records:
        part = pack(raw)
        lines.append("com,example)/ 20200101000000 " + json.dumps({"offset": str(len(body)), "length": str(len(part)), "filename": f"data{suffix}"}))
        body += part
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = b"a comment PK\x05\x06"
        z.writestr("datapackage.json", "{}", compress_type=zipfile.ZIP_STORED)
        z.writestr(f"archive/data{suffix}", body)
        z.writestr("indexes/index.cdxj", "\n".join(lines), compress_type=zipfile.ZIP_STORED)
    return out.getvalue()


RECORDS = [warc_zip.record("response", warc_zip.record_id(k, k), "http://x/", digest(b"body%d" % k), 5, b"body%d" % k) for k in range(9)]


@pytest.mark.parametrize("suffix", [".warc", ".warc.gz", ".warc.zst"])
def test_archives_of_other_writers(spark, tmp_path, suffix):
    (tmp_path / "a.wacz").write_bytes(foreign(RECORDS, suffix))
    got = warc_zip.read_archives(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.payload) for r in got) == [b"body%d" % k for k in range(9)] and {r.digest_ok for r in got} == {"yes"}


def test_wrong_digest_is_told(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(foreign([warc_zip.record("response", "<urn:x>", None, digest(b"other"), 4, b"body")], ".warc"))
    row, = warc_zip.read_archives(spark, str(tmp_path)).collect()
    assert (row.digest_ok, row.payload_digest, row.target_uri) == ("no", digest(b"body"), None)


@pytest.mark.parametrize("raw, message", [
    (b"no archive at all", "no ZIP end record"),
    (foreign(RECORDS, ".warc")[:-40], "no ZIP end record"),
    (foreign(RECORDS * 50, ".warc", zipfile.ZIP_DEFLATED), "is not stored"),
    (foreign(RECORDS, ".warc").replace(b'"offset": "0"', b'"offset":9999'), "outside its member"),
])
def test_broken_archives_are_named(spark, tmp_path, raw, message):
    (tmp_path / "bad.zip").write_bytes(raw)
    with pytest.raises(Exception, match=f"(?s)bad.zip.*{message}"):
        warc_zip.read_archives(spark, str(tmp_path)).collect()


def test_zip64_sizes_come_from_the_extra_field():
    extra = struct.pack("<HHB", 9, 1, 0) + struct.pack("<HHQQ", 1, 16, 5 << 33, 7 << 33)
    assert warc_zip.long_sizes(extra, warc_zip.FULL32, 12, warc_zip.FULL32) == [5 << 33, 12, 7 << 33]


def test_query_over_pages(spark):
    import pyarrow.parquet as pq
    from conftest import SF01
    from tonemill.llm.queries import LLM_QUERIES

    pages = [(r["page_id"], r["html"]) for r in pq.read_table(f"{SF01}/pages.parquet", columns=["page_id", "html"]).to_pylist()]
    got = LLM_QUERIES["op13_warc"](spark, SF01).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(pages)
