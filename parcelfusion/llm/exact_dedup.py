"""Exact deduplication through an extendible-hash index kept in shared files.

Each document has a 64-bit key. A directory over the leading bits of the keys starts with one bucket and doubles
until no bucket holds more than ``capacity`` keys (or the last depth is reached; such a bucket just grows).

Keys that more than one document has are chains: copies of one text, or texts whose keys collide. Their texts go to
the bucket that the directory names. Each mapper combines its equal texts first, so that a group of copies of any size
sends one text a mapper; the task that owns a bucket, a range of keys, then compares the bytes of the texts of each
chain and makes one link per text. The links, in bucket order, are the index in shared files. A document finds its
link there by bucket, key and digest, and where two texts of a chain share even the digest, by the text itself. A
document whose key nobody shares has no chain and stays.

While the chains can be broadcast (``broadcast_rows``), only text of documents in chains is shuffled; beyond that the join
by key shuffles texts once.

Edge cases: a null text counts as empty; empty texts are copies of each other; a null doc_id ranks below every other,
and stays (``kept``) where its group has no other; rows that repeat both doc_id and text are all marked kept; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, sized_join, stored

#: Directory bits at most: 65,536 rows of a few bytes, the proven bound of what is broadcast.
MAX_DEPTH = 16


def records(docs: DataFrame, key_bits: int = 64, digest_bytes: int = 32) -> DataFrame:
    """Of every document: doc_id, key, sha (of the whole digest), digest (what lookups compare) and the normalised text."""
    text = docs.select("doc_id", lower_ascii(F.col("text")).alias("norm"))
    rows = text.select("doc_id", F.shiftleft(F.xxhash64("norm"), 64 - key_bits).alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha"), "norm")
    return rows.withColumn("digest", F.substring("sha", 1, digest_bytes)) if digest_bytes < 32 else rows.withColumn("digest", F.col("sha"))


def prefix(depth: int = MAX_DEPTH) -> Column:
    """Leading ``depth`` bits of the key as an int."""
    return F.shiftrightunsigned(F.col("key"), 64 - depth).cast("int")


def directory(keys: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Directory slot (``max_depth`` leading bits) -> bucket and its local depth.

    Level d of the doubling splits each bucket that is still overfull at level d - 1. A slot's bucket is
    the first level at which its count fits, so one pass over the counts gives what the doubling steps
    would.
    """
    slots = stored(keys.groupBy(prefix(max_depth).alias("slot")).agg(F.count("*").alias("n")), "exact-slots")  # at most 2^max_depth rows
    head = F.expr(f"shiftright(slot, {max_depth} - depth)").alias("head")
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")).select("*", head)
    full = levels.groupBy("depth", "head").agg(F.sum("n").alias("held"))
    fits = full.where((F.col("held") <= capacity) | (F.col("depth") == max_depth)).drop("held")  # at most 2^(max_depth + 1) rows
    first = levels.join(F.broadcast(fits), ["depth", "head"]).groupBy("slot").agg(F.min("depth").alias("local_depth"))
    return first.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {max_depth} - local_depth), {max_depth} - local_depth)"))


def build_index(docs: DataFrame, capacity: int = 4096, key_bits: int = 64, digest_bytes: int = 32, broadcast_rows: int = 300_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records without texts, chains, links).

    chains: key and bucket of the keys of several documents. links: the index, a row per text of a chain, in bucket
    order: bucket, key, link (its place in the chain), digest, norm, keep_id, group_size.
    """
    recs = stored(records(docs, key_bits, digest_bytes).drop("norm"), "exact-records")
    keys = stored(recs.groupBy("key").agg(F.count("*").alias("n")), "exact-keys")
    slots = stored(directory(keys, capacity), "exact-directory")
    chains = keys.where("n > 1").withColumn("slot", prefix()).join(F.broadcast(slots), "slot").select("key", "bucket")
    chains = stored(chains, "exact-chains")
    texts = sized_join(records(docs, key_bits, digest_bytes), chains, "key", "inner", chains.count(), broadcast_rows)
    found = [F.max("doc_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    # The salt keeps this first grouping from being the last one: it only combines, and the owner compares.
    combined = texts.withColumn("group_size", F.lit(1).cast("long")).groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("salt"), "bucket", "key", "digest", "norm").agg(*found)
    owned = combined.repartition("bucket").groupBy("bucket", "key", "digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    link = F.row_number().over(W.partitionBy("bucket", "key").orderBy("digest", "norm")).alias("link")
    index = owned.select("bucket", "key", link, "digest", "norm", "keep_id", "group_size")
    return recs, chains, stored(index, "exact-index")


def exact_dedup(docs: DataFrame, capacity: int = 4096, key_bits: int = 64, digest_bytes: int = 32, broadcast_rows: int = 300_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``capacity``: keys a bucket may hold before it is split. ``key_bits`` and ``digest_bytes``: length of the hash
    key and of the digest (shorter ones only make longer chains and more texts to look up). ``broadcast_rows``: chains up
    to which they are broadcast; beyond it the joins sort-merge.
    """
    recs, chains, index = build_index(docs, capacity, key_bits, digest_bytes, broadcast_rows)
    n = chains.count()
    at = ["bucket", "key", "digest"]
    twins = stored(index.groupBy(*at).count().where("count > 1").select(*at), "exact-twins")
    placed = sized_join(recs, chains, "key", "left", n, broadcast_rows)
    links = index.drop("link", "norm")
    if twins.isEmpty():
        found = sized_join(placed, links, at, "left", links.count(), broadcast_rows)
    else:  # texts with one digest: those documents look up their text
        whole = records(docs, key_bits, digest_bytes).join(chains.hint("merge"), "key", "left")
        own = whole.join(twins.hint("merge"), at, "left_semi").join(index.drop("link").hint("merge"), [*at, "norm"]).drop("norm")
        rest = placed.join(twins.hint("merge"), at, "left_anti").join(links.join(twins.hint("merge"), at, "left_anti").hint("merge"), at, "left")
        found = rest.unionByName(own)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
