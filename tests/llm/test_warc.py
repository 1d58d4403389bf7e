import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from soilcast.llm import queries, warc

from .helpers import clashing


def table(spark):
    rows = [
        (1, "http://a/ x\r\ny", "same"), (2, "http://b", "same"), (3, None, "same"), (4, "u", ""), (5, "u", None), (6, "u", "é\r\n\r\nWARC/1.1\r\n"),
        (7, "u", "long" * 5000), (7, "u", "long" * 5000), (8, "u", "long" * 5000), (None, "u", "only null"), (None, "u", "same"), (9, "u", "tiny"), (9, "u", "tiny"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows, least=0):
    most = {}
    for r in rows:
        p = r.html or ""
        if r.page_id is not None and len(p.encode()) >= least:
            most[p] = max(most.get(p, r.page_id), r.page_id)
    out = []
    for r in rows:
        raw = (r.html or "").encode()
        top = most.get(r.html or "")
        again = top is not None and r.page_id != top
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((r.page_id or -1, len(raw), sha, "revisit" if again else "response", (top if again else -1)))
    return sorted(out)


def got(df):
    return sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in df.collect())


def test_query_against_brute_force(spark, tmp_path):
    df = table(spark)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert got(queries.op6_warc(spark, str(tmp_path))) == expected(df.collect())


@pytest.mark.parametrize(("chunk", "least"), [(7, 0), (1 << 20, 5)])
def test_chunks_round_trip(spark, tmp_path, chunk, least):
    df = clashing(table(spark), "payload", "_sha", "record_type", "chunk_no", "last", "data")
    chunks = warc.record_chunks(warc.with_roles(df, least), chunk=chunk)
    assert all(len(r.data) <= chunk for r in chunks.select("data").collect())
    warc.write_archives(chunks, str(tmp_path / "w"))
    assert got(warc.read_records(spark, str(tmp_path / "w"))) == expected(df.collect(), least)
    parts = {}
    for r in warc.read_chunks(spark, str(tmp_path / "w"), chunk=chunk).where("record_type = 'response'").collect():
        parts.setdefault(r.page_id, {})[r.chunk_no] = r
    for page, html in ((6, "é\r\n\r\nWARC/1.1\r\n"), (8, "long" * 5000)):
        rows = [parts[page][k] for k in sorted(parts[page])]
        assert b"".join(r.data for r in rows) == html.encode() and [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
        so_far = b""
        for r in rows:  # digests grow with the chunks
            so_far += r.data
            assert r.payload_bytes == len(so_far) and r.payload_digest == base64.b32encode(hashlib.sha1(so_far).digest()).decode()


def test_archives_are_warc(spark, tmp_path):
    warc.write_archives(warc.record_chunks(warc.with_roles(table(spark))), str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w/archives").glob("*.warc.gz"))
    n = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        assert lines[0] == "WARC/1.1" and rest[size : size + 4] == b"\r\n\r\n"
        assert (fields["WARC-Type"] == "revisit") == ("WARC-Refers-To" in fields)
        raw, n = rest[size + 4 :], n + 1
    assert n == 13


def test_empty_table(spark, tmp_path):
    warc.write_archives(warc.record_chunks(warc.with_roles(table(spark).limit(0))), str(tmp_path / "w"))
    assert warc.read_records(spark, str(tmp_path / "w")).count() == 0
