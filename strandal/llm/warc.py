"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package holds ``archive/data.warc.gz`` (one gzip member for each record) and ``indexes/index.jsonl``,
both stored, so that a record's place in the package is its place in the member. The reader finds the
central directory from the file's tail (through the ZIP64 records where they are), locates the stored
members, reads the index by range and then the records by ranges of up to ``BLOCK`` bytes.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the smallest page_id is the
response and others are revisits that refer to it; rows that share that smallest page_id are all
responses. A null payload is empty. A null page_id sorts last and is kept. Ids are whole numbers. An empty table gives an
empty result. Columns other than the three named are not read. Packages are named by a random id and listed in a table that Spark commits, so the files
of failed or repeated task attempts are never read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import new_path, ship, stage, table, tidy

LEAST = 100
PACKAGE_BYTES = 128 << 20
BLOCK = 4 << 20
BROADCAST_ROWS = 50_000  # of (digest, first page), some 100 bytes each
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
_DATE = "2020-01-01T00:00:00Z"


def plan_records(df: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which records are responses and which revisit one.

    Only digests that occur more than once are joined back: by broadcast while they are few, else by
    a shuffle of both sides.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    big = F.octet_length("payload") >= LEAST
    first = rows.where(big).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("digest", "first_id")
    first = stage(first, "warc-first")
    few = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # small payloads repeat most and never have a match: each gets a key of its own, so that no task gets them all
    key = F.when(big, F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    first = first.withColumnRenamed("digest", "_w_key")
    rows = rows.withColumn("_w_key", key).join(F.broadcast(first) if few else first, "_w_key", "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has no body but names its payload's digest and length."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    revisit = refers_to is not None
    body = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Package:
    """A ZIP file that is written front to back."""

    def __init__(self, base: str):
        files, path = fs.FileSystem.from_uri(base)
        files.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.zip"
        self.uri = f"{base}/{name}"
        self.out = files.open_output_stream(f"{path}/{name}")
        self.zip = zipfile.ZipFile(_Tell(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps([self.size, len(packed)]))
        self.size += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.out.close()


class _Tell:
    """A write-only stream, as zipfile wants it."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass

    def seekable(self) -> bool:
        return False


def _write(batches, base: str):
    package = None

    def done():
        package.close()
        return pa.RecordBatch.from_arrays([pa.array([package.uri]), pa.array([len(package.index)], pa.int64())], names=["package", "records"])

    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
            page_id, url, payload, digest, refers = (x.as_py() for x in row)
            package = package or Package(base)
            package.add(record(page_id, url, payload.encode("utf-8", "surrogatepass"), digest, refers))
            if package.size >= PACKAGE_BYTES:
                yield done()
                package = None
    if package is not None:
        yield done()


def write_packages(records: DataFrame, base: str) -> DataFrame:
    """Writes packages below ``base``, a folder that all executors share; returns (package, records), committed."""
    ship(records.sparkSession)
    return stage(records.mapInArrow(lambda it: tidy(_write(it, base)), "package string, records long"), "warc-list")


def zip_members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name: (method, packed size, local header's offset), from the central directory."""
    tail_at = max(0, size - 65557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":  # ZIP64 locator, then its end record
        f.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        record64 = f.read(56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("bad ZIP64 end of central directory")
        count, length, at = struct.unpack_from("<QQQ", record64, 32)
    f.seek(at)
    directory, out, p = f.read(length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method, = struct.unpack_from("<H", directory, p + 10)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
        offset, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # the ZIP64 values of those fields that are full, in this order
                have = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                full = next(have) if full == 0xFFFFFFFF else full
                packed = next(have) if packed == 0xFFFFFFFF else packed
                offset = next(have) if offset == 0xFFFFFFFF else offset
            q += 4 + n
        out[name] = method, packed, offset
        p += 46 + n_name + n_extra + n_comment
    return out


def stored_range(f, member: tuple[int, int, int]) -> tuple[int, int]:
    """(offset, size) of a stored member's bytes in the package."""
    method, size, offset = member
    if method != 0:
        raise ValueError("only stored members can be read by range")
    f.seek(offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n_name + n_extra, size


def read_package(uri: str):
    """(headers, body) of every record of a package, by range."""
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as f:
        members = zip_members(f, f.size())
        at, size = stored_range(f, members[INDEX])
        f.seek(at)
        index = [json.loads(x) for x in f.read(size).decode().split("\n") if x]
        base, _ = stored_range(f, members[DATA])
        i = 0
        while i < len(index):
            j, start = i, index[i][0]
            while j < len(index) and (j == i or sum(index[j]) - start <= BLOCK):
                j += 1
            f.seek(base + start)
            block = f.read(sum(index[j - 1]) - start)
            for offset, n in index[i:j]:
                raw = zlib.decompress(block[offset - start : offset - start + n], 31)
                head, _, rest = raw.partition(b"\r\n\r\n")
                headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                yield headers, rest[: int(headers["Content-Length"])]
            i = j


def _page(urn: str | None):
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _read(batches):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for uri in batch.column("package").to_pylist():
            rows = []
            for h, body in read_package(uri):
                revisit = h["WARC-Type"] == "revisit"
                digest = h["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest()
                rows.append((_page(h["WARC-Record-ID"]), int(h["X-Payload-Length"]) if revisit else len(body), digest, h["WARC-Type"], _page(h.get("WARC-Refers-To")), h["WARC-Target-URI"]))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], names=names)


def read_packages(packages: DataFrame) -> DataFrame:
    """One row per record; a package is read by one task."""
    ship(packages.sparkSession)
    n = max(1, packages.count())
    spread = packages.select("package").repartition(min(n, 100_000))
    return spread.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = plan_records(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    packages = write_packages(records, new_path(spark, "warc"))
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Any package of records that is read back says this.
SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
         d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
         f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM f
"""
