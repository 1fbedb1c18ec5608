"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of characters other than the space and the five ASCII controls from tab to return.
WORD = r"[^\x20\x09-\x0D]+"
#: Byte table that lower-cases A-Z alone; UTF-8 keeps every other character clear of those bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character left as it is; null gives ''."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words, as a long; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; if unset, one of our own, in local mode alone."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


#: Folders written inside the open ``temporary`` blocks, the innermost last.
_written: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what :func:`stored` wrote inside; a result that is still to be read belongs to an outer block or to none."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, outer: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives a lost executor.

    Inside ``temporary`` it is deleted when the block ends, or the one ``outer`` blocks around it; without such a block it stays.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_written) > outer:
        _written[-1 - outer].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Inside, Python functions get Arrow batches of some ``most`` bytes, whatever their rows hold; for jobs that run inside the block."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sized_join(left: DataFrame, right: DataFrame, on, how: str, rows: int, limit: int = 300_000) -> DataFrame:
    """Join that broadcasts ``right`` only if its counted ``rows`` are at most ``limit``, else sort-merges.

    The sort-merge form reads both sides straight from their exchanges, so adaptive execution can
    split a hot key.
    """
    return left.join(F.broadcast(right) if rows <= limit else right.hint("merge"), on, how)
