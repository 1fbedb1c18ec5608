"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: a record is a row, its header block and its block, the HTTP response with the page as payload, one string; the writer's
line separator is the blank line pair that ends a record. So archives go to any file system that Spark can write, in files of
bounded record counts.

Reading: a byte scan splits the files at the magic line and gives each piece its offset; every piece is a
candidate record whose Content-Length names its successor's offset. A payload may hold the magic line
too, and then its pieces look like records. Pointer jumping from the start of the file keeps the
candidates that the chain from offset 0 reaches: after round k the chain's first 2^k records are marked
and each pointer spans 2^k records, so rounds grow as the logarithm of a file's records. Pieces between
two reached offsets are put together again as one payload.

Edge cases: null html is an empty payload; null url is an empty target; control characters in a url are
percent-encoded; repeated rows are separate records of one name, as the page_id names a record; equal payloads of one page_id are all
response; payloads are equal when their SHA-256 and length are; a record whose block is no HTTP message is its payload; an
empty table gives an empty archive and result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, sized_join, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a cell of offsets, over which the pieces of cut records are joined to them.
CELL = 1 << 20
EPOCH = "2024-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null for a response).

    A row without a page_id revisits the largest page_id of its payload, if any copy has one; else all copies are responses. Rows that repeat the largest page_id are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
        F.unhex(F.sha2(payload, 256)).alias("same"),  # SHA-1 alone has known collisions, and a false revisit would lose a payload
    )
    long = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("same", "payload_bytes")
    copies = stored(long.agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-copies")
    rows = sized_join(rows, copies, ["same", "payload_bytes"], "left", copies.count())
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(~F.equal_null("first", "page_id"), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 1000, records_per_file: int = 20_000, compression: str = "gzip") -> None:
    """Write one record per page under ``path``."""
    rows = with_revisits(pages, least_bytes)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(HTTP_HEAD), F.col("payload_bytes"), F.lit(END))
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.coalesce(F.col("url"), F.lit(""))
    for code in (13, 10, 0):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    head = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {EPOCH}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *head), F.lit(END), body)
    (
        rows.select(record.alias("value"))
        .write.option("lineSep", END)
        .option("compression", compression)
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


PIECE = """file string, block long, seq long, start long, size long, next long, digest string, length long,
page_id long, kind string, stated_digest string, stated_length long, refers_to long"""


def header_fields(head: bytes) -> dict[bytes, bytes]:
    """Header lines by lower-cased name; the first of a name counts."""
    found: dict[bytes, bytes] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def payload_start(fields: dict[bytes, bytes], block: bytes) -> int:
    """Where the payload starts in a record's block: behind the HTTP header, where it has one."""
    at = block.find(b"\r\n\r\n") if fields.get(b"content-type", b"").lower().startswith(b"application/http") else -1
    return at + 4 if at >= 0 else 0


def whole_number(text: bytes) -> int | None:
    text = text.removeprefix(b"<urn:page:").removesuffix(b">").removeprefix(b"sha1:")
    return int(text) if text.removeprefix(b"-").isdigit() else None


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines, in file order inside each block: file, block, value (bytes)."""
    pieces = spark.read.option("lineSep", MAGIC).text(path)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """file, block, number and offset in the block, and bytes of each piece; a task reads a block's pieces in order."""
    at, seq, off = None, 0, 0
    for batch in batches:
        for file, block, value in zip(batch["file"], batch["block"], batch["value"], strict=True):
            if at != (file, block):
                at, seq, off = (file, block), 0, 0
            yield file, block, seq, off, bytes(value)
            seq, off = seq + 1, off + len(value) + len(MAGIC)


def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every piece as a candidate record: its place, its successor's place relative to its own, its fields.

    A piece that holds its whole record also gives the payload's digest; a record that the magic line in
    its payload has cut gives none yet.
    """
    rows = []
    for file, block, seq, off, body in numbered(batches):
        head, blank, _ = body.partition(b"\r\n\r\n")
        fields = header_fields(head) if blank else {}
        length = whole_number(fields.get(b"content-length", b""))
        begin = len(head) + 4
        digest = payload = None
        if length is not None:
            skip = payload_start(fields, body[begin : begin + length])
            payload = length - skip
            if len(body) >= begin + length:
                digest = hashlib.sha1(body[begin + skip : begin + length]).hexdigest()
        rows.append((
            file, block, seq, off, len(body) + len(MAGIC), None if length is None else len(MAGIC) + begin + length + 4, digest, payload,
            whole_number(fields.get(b"warc-record-id", b"")), fields.get(b"warc-type", b"").decode("utf-8", "replace"),
            fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace"),
            whole_number(fields.get(b"x-payload-length", b"")), whole_number(fields.get(b"warc-refers-to", b"")),
        ))
        if len(rows) >= 5000:
            yield frame(rows)
            rows = []
    yield frame(rows)


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in PIECE.replace("\n", " ").split(",")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({n: "Int64" for n in ("next", "length", "page_id", "stated_length", "refers_to")})


def reachable(chain: DataFrame) -> DataFrame:
    """(file, off, next) -> the (file, off) that the chain from each file's offset 0 reaches, by pointer jumping."""
    chain = chain.where("next is not null")
    jump = chain.select("file", "off", "next")
    reached = chain.where("off = 0").select("file", "off")
    n = 0
    while True:
        steps = jump.select("file", "off", F.col("next").alias("to")).hint("merge")
        further = reached.join(steps, ["file", "off"]).select("file", F.col("to").alias("off"))
        here = chain.select("file", "off").hint("merge")
        reached = stored(reached.unionByName(further.join(here, ["file", "off"], "left_semi")).distinct(), "warc-reached")
        if (now := reached.count()) == n:
            return reached
        n = now
        ahead = jump.select("file", F.col("off").alias("next"), F.col("next").alias("over")).hint("merge")
        jump = stored(jump.join(ahead, ["file", "next"]).select("file", "off", F.col("over").alias("next")), "warc-jump")


def cut_payloads(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(file, block, seq, record, off) of the pieces of cut records -> digest and length of each whole payload."""

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, block, seq, _, body in numbered(batches):
            yield pd.DataFrame({"file": [file], "block": [block], "seq": [seq], "body": [body]})

    def join_up(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("off")
        body = MAGIC.encode().join(bytes(x) for x in pieces["body"])
        head, _, rest = body.partition(b"\r\n\r\n")
        fields = header_fields(head)
        whole = rest[: whole_number(fields.get(b"content-length", b""))]
        digest = hashlib.sha1(whole[payload_start(fields, whole) :]).hexdigest()
        return pd.DataFrame({"file": pieces["file"].iloc[:1], "off": pieces["record"].iloc[:1], "whole_digest": [digest]})

    found = read_pieces(spark, path).mapInPandas(bodies, "file string, block long, seq long, body binary")
    found = found.join(places.hint("merge"), ["file", "block", "seq"])
    return found.groupBy("file", "record").applyInPandas(join_up, "file string, off long, whole_digest string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the archives."""
    pieces = stored(read_pieces(spark, path).mapInPandas(candidates, PIECE), "warc-pieces")
    blocks = pieces.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # A file opens with the magic line, so the empty piece before it counts for that line alone.
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("bytes").over(earlier), F.lit(0)) - len(MAGIC)).alias("base"))
    placed = pieces.join(blocks.hint("merge"), ["file", "block"]).withColumn("off", F.col("base") + F.col("start"))
    placed = stored(placed.withColumn("next", F.col("off") + F.col("next")).where("off >= 0"), "warc-placed")
    reached = reachable(placed)
    records = placed.join(reached.hint("merge"), ["file", "off"], "left_semi")
    # A record that its piece doesn't hold to the end has been cut by magic lines in its payload.
    cuts = stored(records.where("digest is null").select("file", F.col("off").alias("record"), F.col("next").alias("till")), "warc-cuts")
    if not cuts.isEmpty():
        cell = lambda c: F.floor(c / CELL).alias("cell")
        spans = cuts.select("*", F.explode(F.sequence(cell(F.col("record")), cell(F.col("till") - 1))).alias("cell"))
        owned = placed.select("file", "block", "seq", "off", cell(F.col("off"))).join(spans.hint("merge"), ["file", "cell"])
        owned = stored(owned.where("off >= record and off < till").select("file", "block", "seq", "off", "record"), "warc-cut")
        whole = cut_payloads(spark, path, owned)
        records = records.join(whole.hint("merge"), ["file", "off"], "left").withColumn("digest", F.coalesce("whole_digest", "digest"))
    revisit = F.col("kind") == "revisit"
    return records.select(
        "page_id",
        F.when(revisit, F.col("stated_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to WARC files in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    return read_warc(spark, path)
