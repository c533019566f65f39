"""WARC records in ZIP packages: writer, and reader by range without extraction.

**Writing.** Every page becomes a ``response`` record, or a ``revisit`` record
that names the response with an equal payload. Records are single zstd frames in
stored (uncompressed) archive members, ``archive/data-00000.warc.zst``, each with
an index member, ``indexes/data-00000.cdxj``, of offsets and lengths. A task
writes one ZIP as the rows of a plain text sink, so any file system Spark writes
to will do and a lost executor's half file is never committed. The sink ends
each row with a newline; the layout puts one where the format has room for it:
a skippable frame after each record, an extra field at the end of a local
header, the line ends of an index, the comment of the end record. Sizes are not
known in advance, so members carry data descriptors and 64-bit sizes (ZIP64).
A member is closed after ``MEMBER_RECORDS`` or ``MEMBER_BYTES``, which bounds the
index a task holds.

**Reading.** Archives are listed by Spark; a task reads an archive's end record,
its ZIP64 records and its central directory, and the local headers of stored
members; index members are dealt out by themselves (with the list of their
archive's record members), and their entries by file and ``RANGE_BYTES`` block, so that one large archive is read by many tasks. Only
the ranges named are read: neighbours in one request, then record by record.
Plain, gzip (``.gz``) and zstd (``.zst``) records are understood. Executors open
the archives by :func:`open_archive`: local or mounted paths, and those that
``pyarrow.fs`` knows.

Which page is the response: the smallest id of the pages with equal payloads
(SHA-1 and length) of at least ``least_bytes``; of repeated ids the first stored
row; null ids come after all others. Groups of payloads that occur twice or more
are found by an aggregate on digests (copies merge in each task) and joined
back: broadcast up to ``BROADCAST_GROUPS`` groups, else by a merge join whose hot
partitions Spark splits.

Defined cases: a null payload is an empty one, null and empty urls give records
without target; control characters and blanks in a url are percent-encoded; null
ids come back as null; a row per page comes back whatever repeats. An empty table
makes no archive. A file that is no whole ZIP, a member that is not stored or an
index entry outside its member is an error that names the file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tonemill.llm.ragged import in_batches, written

MEMBER_RECORDS = 20_000
MEMBER_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
TASK_BYTES = 64 << 20
BROADCAST_GROUPS = 200_000
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the formats: signatures, profile name, skippable frame.
LOCAL, DESCRIPTOR, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x07\x08", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPED = struct.pack("<II", 0x184D2A50, 1)
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(row: int, name) -> str:
    return f"<urn:page:{row}:{'' if name is None else quote(str(name), safe='')}>"


def record(kind: str, ident: str, url: str | None, digest: str, size: int, payload: bytes = b"", refers: str | None = None) -> bytes:
    """One WARC record; ``size`` is that of the full payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": DATE, "WARC-Target-URI": quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else None,
            "WARC-Refers-To": refers, "WARC-Profile": refers and SAME_PAYLOAD, "WARC-Payload-Digest": f"sha1:{digest}",
            "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


class ZipWriter:
    """Pieces of one ZIP file; each is followed by a newline that is not in it."""

    def __init__(self):
        self.at, self.directory, self.open = 0, [], None

    def piece(self, raw: bytes, member: bool = True) -> bytes:
        self.at += len(raw) + 1
        if member:
            self.open["size"] += len(raw) + 1
            self.open["crc"] = zlib.crc32(b"\n", zlib.crc32(raw, self.open["crc"]))
        return raw

    def start(self, name: str) -> bytes:
        """The end of the member before, and the local header of a new one."""
        before = self.end()
        name = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, 0, 0) + struct.pack("<HH", 0x4E4C, 1)
        self.open = {"name": name, "offset": self.at + len(before), "size": 0, "crc": 0}
        head = LOCAL + struct.pack("<5HIIIHH", 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(name), len(extra) + 1)
        return self.piece(before + head + name + extra, member=False)

    def end(self) -> bytes:
        if not self.open:
            return b""
        done, self.open = self.open, None
        self.directory.append(done)
        return DESCRIPTOR + struct.pack("<IQQ", done["crc"], done["size"], done["size"])

    def finish(self) -> bytes:
        """Descriptor, central directory and end records (32- and 64-bit)."""
        before = self.end()
        start, entries = self.at + len(before), []
        for m in self.directory:
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["offset"])
            entries.append(CENTRAL + struct.pack("<6HIIIHHHHHII", 45, 45, 0x0808, 0, 0, 0x21, m["crc"], FULL32, FULL32, len(m["name"]), len(extra), 0, 0, 0, 0, FULL32) + m["name"] + extra)
        table, n = b"".join(entries), len(entries)
        end64 = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(table), start)
        locator = LOCATOR64 + struct.pack("<IQI", 0, start + len(table), 1)
        end = END + struct.pack("<HHHHIIH", 0, 0, min(n, FULL16), min(n, FULL16), FULL32, FULL32, 1)
        return self.piece(before + table + end64 + locator + end, member=False)


def packed(batches) -> Iterator[pa.RecordBatch]:
    """All pages of a task as the pieces of one ZIP."""
    import zstandard

    zstd, zipped, member, index = zstandard.ZstdCompressor(level=3), ZipWriter(), 0, []

    def closed() -> Iterator[bytes]:
        yield zipped.start(f"indexes/data-{member:05d}.cdxj")
        yield zipped.piece("\n".join(sorted(index)).encode())

    for batch in batches:
        out = []
        for page in batch.to_pylist():
            if not index:
                out.append(zipped.start(f"archive/data-{member:05d}.warc.zst"))
            digest, ident = base32(page["digest"]), record_id(page["row"], page["id"])
            again = page["first_row"] is not None and page["first_row"] != page["row"]
            raw = record("revisit" if again else "response", ident, page["url"], digest, page["size"], b"" if again else page["payload"], record_id(page["first_row"], page["first_id"]) if again else None)
            frame = zstd.compress(raw)
            place = {"offset": zipped.open["size"], "length": len(frame), "digest": f"sha1:{digest}", "type": "revisit" if again else "response", "filename": f"data-{member:05d}.warc.zst"}
            index.append(f"{ident[1:-1]} {re.sub('[^0-9]', '', DATE)} {json.dumps(place)}")
            out.append(zipped.piece(frame + SKIPPED))
            if len(index) >= MEMBER_RECORDS or zipped.open["size"] >= MEMBER_BYTES:
                out += closed()
                member, index = member + 1, []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    last = [*closed()] if index else []
    if last or zipped.open or zipped.directory:
        yield pa.RecordBatch.from_arrays([pa.array([*last, zipped.finish()], pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Write a ZIP of WARC records per task below ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("id", "url", "payload", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "pages")  # row numbers and digests are fixed from here on
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("first")
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.count("*").alias("n"), first).where("n > 1")
    groups = written(groups.select(F.col("digest").alias("of"), F.col("size").alias("of_size"), F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")), "payloads")
    same = (F.col("digest") == F.col("of")) & (F.col("size") == F.col("of_size"))
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        marked = rows.join(F.broadcast(groups), same, "left")
    else:
        marked = rows.hint("merge").join(groups, same, "left")
    again = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    marked = marked.select("id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "size", "row", "first_id", "first_row")
    pieces = in_batches(marked, packed, StructType([StructField("value", BinaryType())]))
    pieces.select(F.col("value").cast("string")).write.option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(path)


def open_archive(path: str):
    """A file that can seek, of a local or mounted path or one pyarrow knows."""
    if path.startswith("file:") or "://" not in path:
        return open(re.sub("^file:/+", "/", path), "rb")
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_file(place)


def read_at(file, at: int, size: int, path: str) -> bytes:
    file.seek(at)
    raw = file.read(size)
    if len(raw) != size:
        raise ValueError(f"{path}: {size} bytes at {at} are not all there")
    return raw


def directory(file, length: int, path: str) -> tuple[int, int, int]:
    """Place, size and number of entries of the central directory, from the end
    record and, where there are any, the ZIP64 records before it."""
    tail_at = max(0, length - 22 - FULL16 - 20)
    tail = read_at(file, tail_at, length - tail_at, path)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError(f"{path}: no ZIP end record")
    n, size, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20:at - 16] == LOCATOR64:
        end64 = read_at(file, struct.unpack_from("<Q", tail, at - 12)[0], 56, path)
        if end64[:4] != END64:
            raise ValueError(f"{path}: no ZIP64 end record where its locator points")
        n, size, start = struct.unpack_from("<QQQ", end64, 32)
    return start, size, n


def zip_members(file, length: int, path: str) -> Iterator[tuple[str, int, int]]:
    """Name, place of the data and size of every stored member."""
    start, size, n = directory(file, length, path)
    buffer, taken = b"", 0
    for _ in range(n):
        while len(buffer) < 3 * FULL16 + 46 and taken < size:
            step = min(1 << 20, size - taken)
            buffer += read_at(file, start + taken, step, path)
            taken += step
        if buffer[:4] != CENTRAL or len(buffer) < 46:
            raise ValueError(f"{path}: broken central directory")
        flags, method = struct.unpack_from("<HH", buffer, 8)
        small, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", buffer, 20)
        offset = struct.unpack_from("<I", buffer, 42)[0]
        name, extra = buffer[46:46 + n_name], buffer[46 + n_name:46 + n_name + n_extra]
        buffer = buffer[46 + n_name + n_extra + n_note:]
        full, small, offset = long_sizes(extra, full, small, offset)
        if name.endswith(b"/"):
            continue
        if method or flags & 1 or full != small:
            raise ValueError(f"{path}: member {name.decode('utf-8', 'replace')} is not stored")
        head = read_at(file, offset, 30, path)
        if head[:4] != LOCAL:
            raise ValueError(f"{path}: no local header at {offset}")
        yield name.decode("utf-8", "replace"), offset + 30 + sum(struct.unpack_from("<HH", head, 26)), full


def long_sizes(extra: bytes, *values: int) -> list[int]:
    """The values, those that are all ones taken from the ZIP64 extra field."""
    out, at = list(values), 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            for k, v in enumerate(values):
                if v == FULL32 and place + 8 <= at + 4 + size:
                    out[k], place = struct.unpack_from("<Q", extra, place)[0], place + 8
        at += 4 + size
    return out


MEMBER = StructType([StructField("name", StringType()), StructField("start", LongType()), StructField("size", LongType())])
MEMBERS = StructType([StructField("path", StringType()), StructField("data", ArrayType(MEMBER)), StructField("indexes", ArrayType(MEMBER))])
RANGES = StructType([StructField("path", StringType()), StructField("name", StringType()), StructField("start", LongType()), StructField("length", LongType())])
RECORDS = StructType([
    StructField("record_id", StringType()), StructField("record_type", StringType()), StructField("target_uri", StringType()), StructField("refers_to", StringType()),
    StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("digest_ok", StringType()), StructField("payload", BinaryType()),
])


def table_of(rows: list, schema: StructType) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields)], names=schema.names)


def listed(batches) -> Iterator[pa.RecordBatch]:
    """Each archive's stored record and index members."""
    for batch in batches:
        for a in batch.to_pylist():
            with open_archive(a["path"]) as file:
                members = [dict(zip(MEMBER.names, m)) for m in zip_members(file, a["length"], a["path"])]
            data = [m for m in members if m["name"].startswith("archive/")]
            yield table_of([(a["path"], data, [m for m in members if m["name"].startswith("indexes/") and m["name"].endswith(".cdxj")])], MEMBERS)


def indexed(batches) -> Iterator[pa.RecordBatch]:
    """Absolute ranges of the records that index members name."""
    for batch in batches:
        for m in batch.to_pylist():
            data = {p["name"].rsplit("/", 1)[-1]: p for p in m["data"]}
            with open_archive(m["path"]) as file:
                for lines in index_lines(file, m["start"], m["size"], m["path"]):
                    rows = []
                    for line in lines:
                        entry = json.loads(line[line.index("{"):])
                        of = data.get(entry["filename"].rsplit("/", 1)[-1])
                        first, length = int(entry["offset"]), int(entry["length"])
                        if of is None or first < 0 or first + length > of["size"]:
                            raise ValueError(f"{m['path']}: index entry outside its member: {line}")
                        rows.append((m["path"], of["name"], of["start"] + first, length))
                    yield table_of(rows, RANGES)


def index_lines(file, start: int, size: int, path: str) -> Iterator[list[str]]:
    """Lines of an index member, about a million bytes at a time."""
    rest, at = b"", 0
    while at < size:
        step = min(1 << 20, size - at)
        *lines, rest = (rest + read_at(file, start + at, step, path)).split(b"\n")
        at += step
        yield [x.decode() for x in lines if b"{" in x]
    if b"{" in rest:
        yield [rest.decode()]


def inflated(raw: bytes, name: str) -> bytes:
    if name.endswith(".gz"):
        return zlib.decompressobj(31).decompress(raw)
    if name.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return raw


def parsed(raw: bytes, payloads: bool) -> tuple:
    """One record's row. The payload of a record without its own (revisit) is
    described by its headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = headers(head)
    block = rest[:int(named["content-length"])]
    http = named.get("content-type", "").startswith("application/http")
    inner, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    told = named.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = named["warc-type"]
    if kind == "revisit":
        size, digest = int(headers(inner).get("content-length", len(body))), told
    else:
        size, digest = len(body), base32(hashlib.sha1(body).digest())
    uri = named.get("warc-target-uri")
    fine = "unknown" if kind == "revisit" or not told else "yes" if told == digest else "no"
    return (named["warc-record-id"], kind, uri, named.get("warc-refers-to"), size, digest, fine, body if payloads and kind != "revisit" else None)


def headers(raw: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}


def reader(payloads: bool):
    """Records of sorted ranges; neighbours are read in one request."""

    def run(batches):
        path, file = None, None
        for batch in batches:
            rows, size, run_of = [], 0, []
            for r in batch.to_pylist():
                if run_of and (r["path"] != run_of[0]["path"] or r["start"] - run_of[-1]["start"] - run_of[-1]["length"] > 4096 or r["start"] - run_of[0]["start"] > RANGE_BYTES):
                    path, file = reopened(path, file, run_of[0]["path"])
                    found = taken(file, run_of, payloads)
                    rows, size, run_of = rows + found, size + sum(len(x[-1] or b"") for x in found), []
                    if size >= RANGE_BYTES:
                        yield table_of(rows, RECORDS)
                        rows, size = [], 0
                run_of.append(r)
            if run_of:
                path, file = reopened(path, file, run_of[0]["path"])
                rows += taken(file, run_of, payloads)
            yield table_of(rows, RECORDS)
        if file:
            file.close()

    return run


def reopened(path, file, wanted):
    if path == wanted:
        return path, file
    if file:
        file.close()
    return wanted, open_archive(wanted)


def taken(file, ranges: list[dict], payloads: bool) -> list[tuple]:
    first = ranges[0]["start"]
    raw = read_at(file, first, max(r["start"] + r["length"] for r in ranges) - first, ranges[0]["path"])
    return [parsed(inflated(raw[r["start"] - first:r["start"] - first + r["length"]], r["name"]), payloads) for r in ranges]


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All indexed records of the ZIP archives below ``path``: ``record_id``,
    ``record_type``, ``target_uri``, ``refers_to``, ``payload_bytes``,
    ``payload_digest`` (bare base32 SHA-1, computed where the record holds the
    payload), ``digest_ok`` (``yes``, ``no``, or ``unknown`` without a payload or a
    told digest) and, with ``payloads``, ``payload`` (null for revisits)."""
    archives = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    total = archives.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(total // TASK_BYTES), spark.sparkContext.defaultParallelism)
    members = in_batches(archives, listed, MEMBERS).select("path", "data", F.inline("indexes"))
    indexes = members.repartition(tasks, "path", "name").select("path", "start", "size", "data")
    ranges = in_batches(indexes, indexed, RANGES)
    block = F.floor(F.col("start") / RANGE_BYTES)
    dealt = ranges.withColumn("block", block).repartition(tasks, "path", "block").sortWithinPartitions("path", "start").drop("block")
    return in_batches(dealt, reader(payloads), RECORDS)


def page_name(ident):
    """The page id in a record id of :func:`write_archives`; null for none."""
    name = F.regexp_extract(ident, "^<urn:page:[0-9]+:(.*)>$", 1)
    return F.when(name != "", F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))

