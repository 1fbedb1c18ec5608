"""Reads of stored tables: search, lookups, reviews, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contains_text(columns: list[str], text: str, wildcards: bool = False) -> Column:
    """Whether any column holds the text, ASCII case ignored; with ``wildcards``, % in it stands for any characters and _ for one."""
    out, plain = F.lit(False), text.translate(str.maketrans(UPPER, LOWER))
    for c in columns:
        low = F.translate(F.col(c).cast("string"), UPPER, LOWER)
        out = out | (F.like(low, F.lit(f"%{plain}%"), F.lit("\x01")) if wildcards else F.contains(low, F.lit(plain)))
    return out


def search(df: DataFrame, text: str | None, columns: list[str], order: str, wildcards: bool = False, **equal) -> DataFrame:
    """Rows with the given column values whose ``columns`` hold ``text``, in order. Equalities reach the scan."""
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    return (df if text is None else df.where(contains_text(columns, text, wildcards))).orderBy(order)


def lookups(keys: DataFrame, parcels: DataFrame) -> DataFrame:
    """key -> the first parcel (by id) with that id, full survey number or survey number."""
    names = parcels.select("parcel_id", F.explode(F.array_distinct(F.array(F.col("parcel_id").cast("string"), "full_survey", "survey_no"))).alias("key"))
    first = names.groupBy("key").agg(F.min("parcel_id").alias("parcel_id"))
    return keys.select("key").distinct().join(first.hint("merge"), "key", "left")


def reviewed(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Conflicts with the last decision on each: APPROVE resolves it and matches its parcel, REJECT dismisses it."""
    last = decisions.groupBy("parcel_id").agg(F.max_by("action", "seq").alias("action"))
    df = conflicts.join(last.hint("merge"), "parcel_id", "left")
    state = F.when(F.col("action") == "APPROVE", "Resolved").when(F.col("action") == "REJECT", "Dismissed").otherwise("Pending")
    return df.withColumn("state", state).withColumn("parcel_status", F.when(F.col("action") == "APPROVE", "Matched").otherwise("Conflict"))


def shares(df: DataFrame, kind: str, amount: str) -> DataFrame:
    """kind, amount, percent of the total: one pass over the groups after the first aggregate."""
    by = df.groupBy(kind).agg(F.sum(amount).alias(amount))
    total = by.agg(F.sum(amount).alias("total"))  # one row
    return by.crossJoin(F.broadcast(total)).select(kind, amount, (F.col(amount) / F.col("total") * 100.0).alias("percent"))
