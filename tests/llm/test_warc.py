import hashlib
import tempfile
from pathlib import Path

from parcelfusion.llm.warc import read_warc, write_warc

SCHEMA = "page_id long, url string, html string, record_type string, body string"


def archive(spark, rows, **how):
    pages = spark.createDataFrame(rows, SCHEMA)
    path = f"{tempfile.mkdtemp()}/w"
    write_warc(pages.repartition(2), path, **how)
    return {r.page_id: r for r in read_warc(spark, path).collect()}, path


def expected(rows):
    by, out = {}, {}
    for i, _, html, *_ in rows:
        by.setdefault(html or "", []).append(i)
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        first = max(by[html or ""]) if len(raw) >= 1000 else i
        out[i] = (len(raw), hashlib.sha1(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
    return out


def test_round_trip_with_records_inside_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    wrong = "WARC/1.1\r\nContent-Length: x\r\n\r\n"
    rows = [
        (1, "http://a/", "x" * 1500, "r", "b"), (2, None, "x" * 1500, None, None), (3, "u\r\nX: y", "", "", ""), (4, "u", None, "", ""),
        (5, "u", f"start {fake}{wrong}end" + "é" * 900, "", ""), (6, "u", fake * 3, "", ""), (7, "u", "WARC/1.1\r\n", "", ""),
        (8, "u", "tiny", "", ""), (9, "u", "tiny", "", ""), (10, "u", f"start {fake}{wrong}end" + "é" * 900, "", ""), (11, "u", "a\r\n\r\n", "", ""),
    ]
    rows += [(i, "u", f"page {i} " * (i % 300), "", "") for i in range(12, 200)]
    want = expected(rows)
    for how in ({}, {"compression": "none"}, {"compression": "none", "records_per_file": 7}):
        got, _ = archive(spark, rows, **how)
        assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()} == want


def test_split_archives(spark):
    rows = [(i, "u", f"<p>WARC/1.1\r\n{i}</p>" * 20, "", "") for i in range(300)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got, _ = archive(spark, rows, compression="none")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()} == expected(rows)


def test_empty(spark):
    got, _ = archive(spark, [])
    assert got == {}


def test_blocks_are_http_messages_and_plain_ones_are_read(spark, tmp_path):
    _, path = archive(spark, [(1, "http://a/", "é" * 700, "", ""), (2, "http://b/", "é" * 700, "", "")], compression="none")
    raw = b"".join(p.read_bytes() for p in sorted(Path(path).glob("part-*")))
    for record in raw.split(b"WARC/1.1\r\n")[1:]:
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n"))
        block = rest[: int(fields[b"Content-Length"])]
        assert rest == block + b"\r\n\r\n" and block.startswith(b"HTTP/1.1 200 OK\r\n") and b"Content-Length: 1400\r\n\r\n" in block
        assert block.endswith("é".encode() * 700) == (fields[b"WARC-Type"] == b"response")
    plain = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(t), t) for k, t in enumerate([b"a\r\n\r\nb", b"", b"WARC/1.1\r\nx"]))
    (tmp_path / "plain.warc").write_bytes(plain)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in read_warc(spark, str(tmp_path / "plain.warc")).collect()}
    assert got == {k: (len(t), hashlib.sha1(t).hexdigest()) for k, t in enumerate([b"a\r\n\r\nb", b"", b"WARC/1.1\r\nx"])}


def test_pages_without_an_id(spark):
    """They revisit the largest id of their payload; without any id all copies are responses."""
    long, other = "y" * 1200, "z" * 1300
    got, _ = archive(spark, [(5, "a", long, None, None), (7, "b", long, None, None), (None, "c", long, None, None)])
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {5: ("revisit", 7, 1200), 7: ("response", None, 1200), None: ("revisit", 7, 1200)}
    got, path = archive(spark, [(None, "c", other, None, None), (None, "d", other, None, None), (7, "e", other[:900], None, None)])
    assert sorted((r.record_type, r.refers_to, r.payload_bytes) for r in read_warc(spark, path).collect()) == [("response", None, 900), ("response", None, 1300), ("response", None, 1300)]
