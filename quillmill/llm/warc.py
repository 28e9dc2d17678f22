"""WARC records in ZIP-packaged archives: a writer, and a reader that never unpacks.

An archive is a ZIP file with two stored members: archive/data.warc.gz (records, each its own gzip member) and
indexes/index.cdxj (a line a record with its offset and length). The reader parses the end record, the ZIP64 records and
the central directory, finds where the stored members' bytes lie, reads the index, and range-reads records.

Of records with equal payloads of at least min_bytes, that with the largest id is the response and the others are
revisits of it, without a payload; shorter ones are all responses.

Defined results: a null payload is empty. A null id is less than every other. Repeated rows (equal id and payload) are
written as often as they occur, each a response if it has the group's largest id. Other columns aren't read. An empty
table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches as cut_batches, settle, shared_dir, table, texts, tune

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 16 << 20
READ_BYTES = 4 << 20
#: All records carry the same date, so that a rerun writes the same bytes.
DATE = "2020-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def surt(url: str | None) -> str:
    """Host labels reversed, then the path: the key by which an index is sorted."""
    try:
        s = urlsplit(url or "")
        host = ",".join(reversed((s.hostname or "").split(".")))
    except ValueError:
        return url or ""
    return f"{host}){s.path or '/'}" + (f"?{s.query}" if s.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Truncated: length"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """What a record says; raises ValueError where its digests don't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(said["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest = said["warc-payload-digest"].removeprefix("sha1:")
    if said["warc-block-digest"].removeprefix("sha1:") != payload_digest(block):
        raise ValueError("block digest differs")
    if said["warc-type"] == "response" and payload_digest(payload) != digest:
        raise ValueError("payload digest differs")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number(said["warc-record-id"]), "url": said.get("warc-target-uri"), "record_type": said["warc-type"], "payload": payload if said["warc-type"] == "response" else None, "payload_bytes": length, "payload_digest": digest, "refers_to": number(said["warc-refers-to"]) if "warc-refers-to" in said else None}


class ArchiveWriter:
    """Gathers records; close() gives the archive's bytes."""

    def __init__(self):
        self.data, self.index = io.BytesIO(), []

    def add(self, page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> int:
        deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
        raw = record(page_id, url, payload, digest, refers_to, revisit)
        packed = deflate.compress(raw) + deflate.flush()
        self.index.append((surt(url), json.dumps({"id": page_id, "offset": self.data.tell(), "length": len(packed), "digest": digest, "type": "revisit" if revisit else "response"})))
        self.data.write(packed)
        return self.data.tell()

    def close(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(zipfile.ZipInfo(DATA), self.data.getvalue())
            z.writestr(zipfile.ZipInfo(INDEX), "".join(f"{k} {DATE} {v}\n" for k, v in sorted(self.index)))
        return out.getvalue()


class ArchiveReader:
    """Reads an archive by ranges. read(offset, length) gives bytes; size is the archive's."""

    def __init__(self, read, size: int):
        self.read, self.members = read, {}
        at, length = self._directory(size)
        directory, p = read(at, length), 0
        while p + 46 <= len(directory) and directory[p : p + 4] == b"PK\x01\x02":
            method, packed, plain, n_name, n_extra, n_note, header = struct.unpack_from("<10xH8xIIHHH8xI", directory, p)
            name = directory[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
            extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
            packed, header = self._wide(extra, plain, packed, header)
            self.members[name] = (method, header, packed)
            p += 46 + n_name + n_extra + n_note

    def _directory(self, size: int) -> tuple[int, int]:
        """Where the central directory lies: from the end record, or the ZIP64 end record that a locator before it points to."""
        tail_at = max(0, size - 65_557)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no ZIP archive: the end record is missing")
        length, at = struct.unpack_from("<II", tail, end + 12)
        locator = tail[end - 20 : end] if end >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            (at64,) = struct.unpack_from("<Q", locator, 8)
            record64 = self.read(at64, 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 end record is missing")
            length, at = struct.unpack_from("<QQ", record64, 40)
        return at, length

    @staticmethod
    def _wide(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int]:
        """Sizes and offsets that stand in a ZIP64 extra field, in fixed order, each only if its short field is full."""
        p = 0
        while p + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, p)
            if kind == 1:
                fields, q = extra[p + 4 : p + 4 + n], 0
                if plain == 0xFFFFFFFF:
                    q += 8
                if packed == 0xFFFFFFFF:
                    (packed,) = struct.unpack_from("<Q", fields, q)
                    q += 8
                if header == 0xFFFFFFFF:
                    (header,) = struct.unpack_from("<Q", fields, q)
            p += 4 + n
        return packed, header

    def span(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        method, header, length = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed as a whole, so its records can't be read by range")
        n_name, n_extra = struct.unpack_from("<HH", self.read(header, 30), 26)
        return header + 30 + n_name + n_extra, length

    def index(self) -> list[dict]:
        """The index's entries, in the order of their offsets."""
        lines = self.read(*self.span(INDEX)).decode().splitlines()
        return sorted((json.loads(x[x.index(" {") + 1 :]) for x in lines), key=lambda e: e["offset"])

    def records(self, want=None) -> Iterator[dict]:
        """The records whose index entry want accepts, or all; neighbours are read together."""
        base, _ = self.span(DATA)
        run: list[dict] = []
        for e in [*(x for x in self.index() if want is None or want(x)), None]:
            if run and (e is None or e["offset"] != run[-1]["offset"] + run[-1]["length"] or e["offset"] + e["length"] - run[0]["offset"] > READ_BYTES):
                got = self.read(base + run[0]["offset"], run[-1]["offset"] + run[-1]["length"] - run[0]["offset"])
                for x in run:
                    at = x["offset"] - run[0]["offset"]
                    yield parse_record(zlib.decompress(got[at : at + x["length"]], 31))
                run = []
            if e is not None:
                run.append(e)


def _open(uri: str):
    from pyarrow import fs

    # The same store under the name that this library has for it.
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives under root, a folder that all executors share; returns (archive, records), settled.

    A task's archives have names of their own, and only those of tasks that ended well are in the returned table, so
    tasks that run twice do no harm.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha", F.sha1("payload"))
    # Which rows are revisits is found from ids and digests alone. A payload that very many pages have is a hot key there, of
    # two tables that are read from files, so that Spark can split it; the payloads themselves are dealt by page.
    ids = settle(rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", "sha"))
    last = settle(ids.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null").drop("n"))
    again = ids.join(last, "sha").filter(~F.col("page_id").eqNullSafe(F.col("last"))).select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "last").distinct()
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left").withColumn("revisit", F.col("last").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        fs.create_dir(folder, recursive=True)
        made, writer = [], None

        def end() -> None:
            name = f"{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{folder}/{name}") as f:
                f.write(writer.close())
            made.append((f"{root}/{name}", len(writer.index)))

        for b in cut_batches(batches, column="payload"):
            for page, url, payload, last, revisit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                writer = writer or ArchiveWriter()
                if writer.add(page, url, payload, payload_digest(payload), last if revisit else None, revisit) >= archive_bytes:
                    end()
                    writer = None
        if writer is not None:
            end()
        yield pa.record_batch([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64())], names=["archive", "records"])

    return settle(rows.select("page_id", "url", "payload", "last", "revisit").mapInArrow(run, "archive string, records long"))


READ_SCHEMA = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in archives.archive; payload is null for revisits, and for all if payloads is False."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = _open(uri)
                with fs.open_input_file(path) as f:
                    reader, held, size = ArchiveReader(lambda at, n, f=f: f.read_at(n, at), f.size()), [], 0
                    for r in reader.records():
                        held.append(r if payloads else r | {"payload": None})
                        size += len(r["payload"] or b"")
                        if size > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return archives.select("archive").repartition(n).mapInArrow(run, READ_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS last FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(s, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM k)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
