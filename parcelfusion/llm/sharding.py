"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Documents fall into logical partitions by a hash of their id. How many documents of each partition go
to each shard is drawn exactly as a uniform random permutation would send them: row by row from the
multivariate hypergeometric distribution, given the shard sizes. Each partition is permuted locally and
cut into runs of the drawn lengths; the runs are exchanged; each shard is permuted again. The law is
``rows``: shard sizes differ by one document at most.

The matrix has at most 65,536 x shards counts, whatever the input; it is drawn on the driver from the
partition counts. Hash-ordered buckets keep every sort bounded: no task holds a shard.

Edge cases: null text has 8 bytes of size and the checksum of the empty text; a null doc_id hashes by its
text; repeated rows are separate documents; an empty table gives an empty result; extra columns are
ignored, or kept on request, where one with the name of a result column becomes ``document_<name>``.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .mixing import shuffle_key

#: Bits of the number of partitions at most; rows a partition should have while there are fewer.
MAX_BITS, PART_ROWS = 16, 1000
NAMES = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}


def hypergeometric(good: int, bad: int, drawn: int, u: float) -> int:
    """The ``u`` quantile of the number of good among ``drawn`` from good + bad, by its probabilities.

    Probabilities within 40 standard deviations of the mean are summed; beyond that they round to 0.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    n = good + bad
    mean = drawn * good / n
    sd = math.sqrt(max(1.0, mean * (bad / n) * (n - drawn) / max(1, n - 1)))
    k = np.arange(max(low, int(mean - 40 * sd)), min(high, int(mean + 40 * sd) + 1) + 1, dtype=np.float64)
    ratio = np.log((good - k[:-1]) * (drawn - k[:-1])) - np.log((k[:-1] + 1) * (bad - drawn + k[:-1] + 1))
    logs = np.r_[0.0, np.cumsum(ratio)]
    p = np.exp(logs - logs.max())
    return int(k[min(len(k) - 1, np.searchsorted(np.cumsum(p), u * p.sum(), side="right"))])


def communication_matrix(counts: list[int], shards: int, seed: int = 0) -> list[list[int]]:
    """Row i: how many of partition i's documents go to each shard. Columns sum to the shard sizes."""
    rng = np.random.default_rng([seed, sum(counts), shards])
    total = sum(counts)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    rows = []
    for count in counts:
        row, left, open_ = [], count, sum(room)
        for j in range(shards):
            open_ -= room[j]
            take = hypergeometric(room[j], open_, left, rng.random())
            row.append(take)
            left -= take
        room = [a - b for a, b in zip(room, row, strict=True)]
        rows.append(row)
    return rows


def shard(docs: DataFrame, shards: int = 24, seed: int = 0, keep_columns: bool = False) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    With ``keep_columns`` the documents themselves are exchanged: their other columns come along.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    place, order = shuffle_key(F.col("doc_id"), f"local:{seed}:", text), shuffle_key(F.col("doc_id"), f"shard:{seed}:", text)
    others = [c for c in docs.columns if c != "doc_id"] if keep_columns else []
    body = [F.struct(*[F.col(f"`{c}`").alias(f"document_{c}" if c.lower() in NAMES else c) for c in others]).alias("doc")] if others else []
    fine = F.conv(F.substring(place, 1, MAX_BITS // 4), 16, 10).cast("int")
    found = docs.groupBy(fine.alias("part")).count().collect()  # at most 2^MAX_BITS rows
    n = sum(c for _, c in found)
    parts = min(1 << MAX_BITS, 1 << max(0, math.ceil(math.log2(max(1, n) / PART_ROWS))))
    part = (fine % parts).cast("int").alias("part")
    counts: dict[int, int] = {}
    for i, c in found:
        counts[i % parts] = counts.get(i % parts, 0) + c
    matrix = communication_matrix([counts.get(i, 0) for i in range(parts)], shards, seed)
    digits = max(1, math.ceil(math.log(max(1, n) / shards / PART_ROWS, 16)))
    ends = json.dumps(np.cumsum(matrix, axis=1).tolist())
    runs = spark.range(1).select(F.posexplode(F.from_json(F.lit(ends), "array<array<bigint>>")).alias("part", "ends"))
    size, checksum = (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    rows = docs.select("doc_id", size, checksum, place.alias("place"), order.alias("order"), part, *body)
    local = F.row_number().over(W.partitionBy("part").orderBy("place", "doc_id", "text_crc32", "size")) - 1
    sent = rows.withColumn("local", local).join(F.broadcast(runs), "part")
    sent = sent.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("local")))).withColumn("bucket", F.substring("order", 1, digits))
    sent = stored(sent.drop("part", "ends", "local", "place"), "shard-sent")
    earlier = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("order", "doc_id", "text_crc32", "size")) - 1
    return sent.join(offsets.hint("merge"), ["shard", "bucket"]).select(
        "doc_id",
        *(["doc.*"] if body else []),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("offset") + inside).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
