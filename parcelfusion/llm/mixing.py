"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue whose documents stand in a shuffled (hash) order and may be served up to
``max_repeats`` times. A document copy's virtual finish time is its source's cumulative words divided by
the source's target. The copies of all sources are range-sorted by virtual finish, and the sequence is truncated where
its running total of words reaches the budget, the total of the corpus; the copy across the cut gives its leading
words. At that point every source has served its target, give or take a document.

No task holds a source or the whole order. Cumulative words: hash-order buckets are summed first, the bucket sums are
accumulated by levels of three digits of the hash, so a window has 4,096 rows at most, and rows accumulate inside their own bucket. Running total: ranges of virtual finish are summed
first, and only the range in which the budget is reached is accumulated row by row. That gives the cut, one point of
the order, and each document counts its copies before it. The copies that start before virtual time 1 together hold the
budget, so those that finish after all of them need no place in the order.

Edge cases: null text has size 0; null source is a source of its own, last in order; a document without a word
takes nothing and stands in the order where its queue is; null doc_ids are ordered by text; repeated rows are
separate documents; an empty table gives an empty result; extra columns are ignored by ``mix`` and kept
by ``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, stored

#: Documents that a hash-order bucket should have; the number of buckets follows the number of documents.
BUCKET_ROWS = 512


def source_key(source: Column) -> Column:
    """String that sorts as the source by code point, null last."""
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))


def shuffle_key(doc_id: Column, seed: str, text: Column | None = None) -> Column:
    """Hex digest that puts documents in a shuffled order that every run repeats; null ids go by ``text``, if given."""
    other = F.lit("") if text is None else F.concat(F.lit("null:"), F.coalesce(F.xxhash64(text).cast("string"), F.lit("")))
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), other)).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(src, source_size) -> src, source_size, target: the total shared by weight, none above ``max_repeats`` times its size.

    Sources sorted by size over weight fill up in that order; the first whose uncapped share fits, and
    all after it, share the rest. One row per source, so one task orders them.
    """
    big = "decimal(38,0)"
    by_code = W.orderBy("src")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast(big)).withColumn("cap", (F.col("source_size") * max_repeats).cast(big))
    order = W.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), "src")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("left", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast(big))
    s = s.withColumn("den", F.sum("weight").over(after).cast(big)).withColumn("place", F.row_number().over(order))
    fits = F.col("left").cast("double") * F.col("weight").cast("double") <= F.col("cap").cast("double") * F.col("den").cast("double")
    s = s.withColumn("first", F.min(F.struct(F.when(fits, F.col("place")).otherwise(2**31 - 1).alias("place"), F.col("left"), F.col("den"))).over(every))
    share = (F.col("weight").cast("double") * F.col("first.left").cast("double")) / F.col("first.den").cast("double")
    target = F.when(F.col("place") < F.col("first.place"), F.col("cap").cast("double")).otherwise(share)
    return s.select("src", "source_size", target.alias("target"))


def offsets(sums: DataFrame, digits: int, step: int = 3) -> DataFrame:
    """Adds offset, the words of the source in the buckets before, to src, bucket (``digits`` hex digits) and bucket_size.

    Prefixes of ``step`` digits more are accumulated inside the prefix before them, so no window has more than 16^step rows.
    """
    cuts = [*range(step, digits, step), digits]
    out = sums.withColumn("offset", F.lit(0).cast("long"))
    for low, high in zip([0, *cuts], cuts, strict=False):
        part = sums.groupBy("src", F.substring("bucket", 1, high).alias("prefix")).agg(F.sum("bucket_size").alias("held"))
        earlier = W.partitionBy("src", F.substring("prefix", 1, low)).orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
        part = part.select("src", "prefix", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("more"))
        out = out.withColumn("prefix", F.substring("bucket", 1, high)).join(part.hint("merge"), ["src", "prefix"]).withColumn("offset", F.col("offset") + F.col("more")).drop("prefix", "more")
    return out


def queue(docs: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: str, keep_columns: bool) -> DataFrame:
    """doc_id, size, src, place, tie, source_size, target, start (words of the source before the document), and ``doc``."""
    text = F.coalesce("text", F.lit(""))
    digits = max(1, math.ceil(math.log(max(1, docs.count()) / BUCKET_ROWS, 16)))
    keys = [source_key(F.col("source")).alias("src"), shuffle_key(F.col("doc_id"), seed, text).alias("place")]
    narrow = stored(docs.select(*keys, n_words(F.col("text")).alias("size"), "doc_id", F.xxhash64(text).alias("tie")), "mix-sizes")
    bucket = F.substring("place", 1, digits).alias("bucket")
    sums = narrow.groupBy("src", bucket).agg(F.sum("size").alias("bucket_size"))
    sums = stored(offsets(stored(sums, "mix-sums"), digits), "mix-buckets")
    goal = targets(sums.groupBy("src").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats)
    sums = stored(sums.join(goal.hint("merge"), "src").drop("bucket_size"), "mix-offsets")
    rows = narrow
    if keep_columns:
        body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
        rows = docs.select(*keys, n_words(F.col("text")).alias("size"), "doc_id", F.xxhash64(text).alias("tie"), body)
    inside = W.partitionBy("src", "bucket").orderBy("place", "doc_id", "tie").rowsBetween(W.unboundedPreceding, 0)
    queued = rows.withColumn("bucket", bucket).join(sums.hint("merge"), ["src", "bucket"])
    return queued.withColumn("start", F.col("offset") + F.sum("size").over(inside) - F.col("size")).drop("bucket", "offset")


def place_of(turn: Column) -> dict[str, Column]:
    """Sort key of a document's copy: virtual finish, then source, shuffled place, id and text, then the turn."""
    finish = F.when(F.col("target") > 0, (F.col("start") + F.col("size") + turn * F.col("source_size")) / F.col("target")).otherwise(0.0)
    return {"finish": finish, **{c: F.col(c) for c in ("src", "place", "doc_id", "tie")}, "turn": turn}


def cut(queued: DataFrame, max_repeats: int) -> dict | None:
    """Where the order is truncated: the place of the copy across the cut and the words it gives; None where nothing has words."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("turn")
    begin = (F.col("start") + F.col("turn") * F.col("source_size")) / F.col("target")
    place = place_of(F.col("turn"))
    copies = queued.where("size > 0").select("*", turn).select("size", begin.alias("begin"), *[v.alias(k) for k, v in place.items()])
    enough = copies.where("begin < 1").agg(F.max("finish")).first()[0]
    served = copies.where(F.col("finish") <= F.lit(enough)).drop("begin")
    ranges = stored(served.repartitionByRange(*place).withColumn("range", F.spark_partition_id()), "mix-order")
    held = ranges.groupBy("range").agg(F.sum("size").alias("held")).orderBy("range").collect()  # one row a partition
    total = queued.agg(F.sum("size")).first()[0] or 0
    budget, before = min(total, sum(r["held"] for r in held)), 0
    for r in held:
        if before + r["held"] >= budget:
            running = F.sum("size").over(W.partitionBy("range").orderBy(*place).rowsBetween(W.unboundedPreceding, 0)) + F.lit(before)
            there = ranges.where(F.col("range") == r["range"]).withColumn("running", running).where(F.col("running") >= budget)
            return there.withColumn("gives", F.col("size") - F.col("running") + F.lit(budget)).orderBy(*place).first().asDict()
        before += r["held"]
    return None


def compared(at: dict, turn: Column) -> tuple[Column, Column]:
    """Whether the copy of this turn stands before the cut, and whether it is the copy across it. Nulls sort first."""
    before, same = F.lit(False), F.lit(True)
    for name, value in place_of(turn).items():
        less = F.lit(False) if at[name] is None else F.coalesce(value < F.lit(at[name]), F.lit(True))
        before, same = before | (same & less), same & value.eqNullSafe(F.lit(at[name]))
    return before, same


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix:") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and the ``virtual_finish`` of its first copy."""
    queued = stored(queue(docs, weights, max_repeats, seed, False), "mix-queued")
    at = cut(queued, max_repeats)
    taken = F.lit(0)
    for k in range(max_repeats if at else 0):
        before, same = compared(at, F.lit(k))
        taken = taken + F.when(before, F.col("size")).when(same, F.lit(at["gives"])).otherwise(0)
    finish = F.when(F.col("target") > 0, place_of(F.lit(0))["finish"])
    return queued.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), finish.alias("virtual_finish"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix:") -> DataFrame:
    """The mix itself: each document as often as it stands before the cut; the one across the cut is left whole.

    A source without words has no queue, and its documents are served once. Returns the columns of ``docs``.
    """
    at = cut(stored(queue(docs, weights, max_repeats, seed, False), "mix-queued"), max_repeats)
    if at is None:
        return docs
    served = queue(docs, weights, max_repeats, seed, True).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    before, same = compared(at, F.col("turn"))
    return served.where((before | same) & ((F.col("target") > 0) | (F.col("turn") == 0))).select("doc.*")
