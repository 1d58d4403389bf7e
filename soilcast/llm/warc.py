"""WARC archives as a chunked record table.

Payloads travel as rows of a record's identifier and a chunk number, never longer than ``CHUNK`` bytes, and
carry the SHA-1 and length of the bytes so far, so neither writer nor reader holds a whole record. Every
record is a gzip member of its own; the manifest lists stretches of whole members, which are read in
parallel.

Tasks write archives under names of their own attempt and report them; the manifest, written by
Spark, names those that count, so a repeated or lost task leaves no wrong record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, reserved

#: Bytes of payload in a row.
CHUNK = 1 << 20
#: Compressed bytes after which a stretch of an archive, and an archive, ends.
STRETCH = 8 << 20
ARCHIVE = 1 << 30
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, first long, behind long, records long"


def _open(uri: str):
    """(filesystem, path) for a folder or file below the shared folder."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def with_roles(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` with ``payload`` (the html in UTF-8, NULL: empty), ``record_type`` and ``refers_to``.

    Of the rows with one payload of at least ``min_bytes`` bytes, the one with the largest id is the
    ``response`` and the others are ``revisit`` rows that refer to its id; smaller payloads are all responses.
    Rows that repeat the largest id are all responses; a NULL id is below every other, and a payload
    that only has NULL ids has only responses. Columns with these names are replaced.
    """
    sha, most, twin = (reserved(pages, c) for c in ("_sha", "_most", "_twin"))
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.withColumn("payload", payload).withColumn(sha, F.sha1("payload"))
    # Counted in the tasks that read the pages, so a payload with very many copies is no large group.
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy(F.col(sha).alias(twin)).agg(
        F.max(id_col).alias(most), F.count(F.lit(1)).alias("_copies")
    )
    groups = groups.where("_copies > 1").drop("_copies")
    rows = rows.join(groups, F.col(sha) == F.col(twin), "left")
    again = F.col(most).isNotNull() & ~F.col(id_col).eqNullSafe(F.col(most))
    return (
        rows.withColumn("record_type", F.when(again, F.lit("revisit")).otherwise(F.lit("response")))
        .withColumn("refers_to", F.when(again, F.col(most)))
        .withColumn("payload_sha1", F.col(sha))
        .drop(sha, most, twin)
    )


def record_chunks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of records from ``with_roles``: ``page_id``, ``url``, ``record_type``, ``refers_to``,
    ``payload_sha1``, ``n_bytes`` (of the payload), ``chunk_no``, ``last``, ``data``. A revisit has one empty chunk."""
    n = F.octet_length("payload").cast("long")
    sent = F.when(F.col("record_type") == "revisit", F.lit(0).cast("long")).otherwise(n)
    last = F.greatest(F.ceil(sent / chunk).cast("int") - 1, F.lit(0))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), "record_type",
        F.col("refers_to").cast("long").alias("refers_to"), "payload_sha1", n.alias("n_bytes"), last.alias("_last"), "payload",
    )
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("chunk_no"))
    data = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(
        F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))
    )
    return rows.select(
        "page_id", "url", "record_type", "refers_to", "payload_sha1", "n_bytes", "chunk_no",
        (F.col("chunk_no") == F.col("_last")).alias("last"), data.alias("data"),
    )


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def _head(row: dict, date: str) -> bytes:
    """The record's header and the HTTP header that begins its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n"
    revisit = row["record_type"] == "revisit"
    lines = [
        VERSION,
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {record_id(row['page_id'])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(row['url']) if row['url'] else 'urn:none'}",
        f"WARC-Payload-Digest: sha1:{_base32(bytes.fromhex(row['payload_sha1']))}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else row['n_bytes'])}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode("utf-8")


def write_archives(chunks: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write the records of ``chunks`` (chunks of a record follow each other) under ``folder``/archives and
    return the manifest (``MANIFEST``), itself written to ``folder``/manifest. An empty table gives an empty manifest."""
    spark = chunks.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(f"{folder}/archives")
        out = name = gz = None
        first = at = records = 0

        def stretch() -> pa.RecordBatch:
            row = {"file": name, "first": first, "behind": at, "records": records}
            return pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("first", "behind", "records"))]))

        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"  # of this attempt alone
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    first = at = records = 0
                if row["chunk_no"] == 0:
                    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(gz.compress(_head(row, date)))
                raw = gz.compress(row["data"])
                if row["last"]:
                    raw += gz.compress(b"\r\n\r\n") + gz.flush()
                    records += 1
                out.write(raw)
                at = out.tell()
                if row["last"] and at - first >= STRETCH:
                    yield stretch()
                    first, records = at, 0
                    if at >= ARCHIVE:
                        out.close()
                        out = None
        if out is not None:
            out.close()
            if records:
                yield stretch()

    map_batches(chunks, run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _Members:
    """The gzip members between two offsets of a stream, inflated a little at a time."""

    def __init__(self, stream, n: int):
        self.stream, self.left, self.raw, self.out, self.inflate = stream, n, b"", b"", None

    def _more(self) -> bool:
        """Add inflated bytes of the present member; False at its end."""
        while not self.inflate.eof:
            if not self.raw:
                self.raw = self.stream.read(min(1 << 18, self.left))
                self.left -= len(self.raw)
                if not self.raw:
                    raise ValueError("an archive ends inside a record")
            got = self.inflate.decompress(self.raw, 1 << 18)
            self.raw = self.inflate.unconsumed_tail or (self.inflate.unused_data if self.inflate.eof else b"")
            if got:
                self.out += got
                return True
        return False

    def next_member(self) -> bool:
        if not self.raw and self.left <= 0:
            return False
        self.out, self.inflate = b"", zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes:
        while (k := self.out.find(mark)) < 0:
            if not self._more():
                raise ValueError("a record's header has no end")
        got, self.out = self.out[:k], self.out[k + len(mark) :]
        return got

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise ValueError("a record is shorter than its length")
        got, self.out = self.out[:n], self.out[n:]
        return got

    def end(self) -> None:
        if self.take(4) != b"\r\n\r\n" or self._more() or self.out:
            raise ValueError("a record does not end where its length says")


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


CHUNKS = (
    "page_id long, record_type string, refers_to long, url string, chunk_no int, last boolean, "
    "payload_bytes long, payload_digest string, data binary"
)


def read_chunks(spark: SparkSession, folder: str, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The records below ``folder`` as chunk rows (``CHUNKS``).

    ``payload_bytes`` and ``payload_digest`` (base32 SHA-1) cover the payload up to and including the chunk; on the
    last chunk they are the record's, checked against its headers. A revisit has one chunk without data
    and the digest and length of the payload it refers to. ``with_data`` False leaves ``data`` NULL.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n = max(1, manifest.count())
    parts = manifest.repartitionByRange(n, "file", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(f"{folder}/archives")
        schema = pa.schema(
            [
                ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()),
                ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary()),
            ]
        )
        for b in batches:
            for part in b.to_pylist():
                rows, held = [], 0
                for row in _records(fs, f"{base}/{part['file']}", part["first"], part["behind"], chunk):
                    held += len(row["data"])
                    if not with_data:
                        row["data"] = None
                    rows.append(row)
                    if len(rows) >= 1000 or held >= 4 * chunk:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return map_batches(parts, run, CHUNKS)


def _records(fs, path: str, first: int, behind: int, chunk: int) -> Iterator[dict]:
    with fs.open_input_file(path) as stream:
        stream.seek(first)
        members = _Members(stream, behind - first)
        while members.next_member():
            head = _headers(members.until(b"\r\n\r\n"))
            before = members.until(b"\r\n\r\n")
            http = _headers(before)
            left = int(head["content-length"]) - len(before) - 4
            wanted = head["warc-payload-digest"].removeprefix("sha1:")
            row = {
                "page_id": _page_of(head["warc-record-id"]), "record_type": head["warc-type"], "url": head["warc-target-uri"],
                "refers_to": _page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None,
            }
            if row["record_type"] == "revisit":
                members.end()
                yield row | {"chunk_no": 0, "last": True, "payload_bytes": int(http["content-length"]), "payload_digest": wanted, "data": b""}
                continue
            sha, so_far, k = hashlib.sha1(), 0, 0
            while True:
                data = members.take(min(chunk, left))
                left -= len(data)
                sha.update(data)
                so_far += len(data)
                digest = _base32(sha.digest())
                if not left:
                    members.end()
                    if digest != wanted or so_far != int(http["content-length"]):
                        raise ValueError(f"the payload of {head['warc-record-id']} is not what its header says")
                yield row | {"chunk_no": k, "last": not left, "payload_bytes": so_far, "payload_digest": digest, "data": data}
                k += 1
                if not left:
                    break


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``url``."""
    return read_chunks(spark, folder, with_data=False).where("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
