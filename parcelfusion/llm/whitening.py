"""Embedding whitening by weighted multiplicity: equal vectors are grouped, fitted with their number as weight, and whitened once.

Entries c become whole numbers x = floor(scale * c) + shift, so the sums that centre the vectors are exact. The covariance is summed over the
distinct vectors by a weighted matrix product of the centred rows of each task; tasks give one matrix each, which Spark adds up entry by entry. Only
that matrix, as large as a vector is long, reaches the driver, for its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Entries at or above this, scaled, have no whole number of 64 bits.
REACH = float(1 << 62)
LONG = 1 << 63


def whole(vector: str, scale: int, shift: int):
    """The vector's entries as longs; null where it is null or an entry is null, not finite or beyond ``REACH``."""
    c = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < REACH / scale)), F.lit(False))
    return F.when(fine, F.transform(c, lambda v: F.floor(v * float(scale)) + F.lit(shift)))


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exactly(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Sums of w x by column, as Python's whole numbers where 64 bits could be too few."""
    bound = int(np.abs(x).max(initial=0)) * int(w.sum())
    return (w @ x).tolist() if bound < LONG else (w.astype(object) @ x.astype(object)).tolist()


def by_length(batches: Iterator[pa.RecordBatch], column: str, kind=np.int64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, vectors, weights) of the vectors of each length in each batch."""
    for batch in batches:
        lengths = np.asarray(batch.column("dim"))
        for d in np.unique(lengths):
            some = batch.filter(pa.array(lengths == d))
            yield int(d), matrix(some.column(column), kind), np.asarray(some.column("weight"))


def entry_sums(vectors: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums over tasks of ``partial``: per length an array of doubles, added up entry by entry in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, m in partial(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d, np.int32)), pa.array(np.arange(m.size)), pa.array(m.reshape(-1))], ["dim", "entry", "part"])

    found = vectors.mapInArrow(run, "dim int, entry long, part double").groupBy("dim", "entry").agg(F.sum("part").alias("part")).toArrow().sort_by([("dim", "ascending"), ("entry", "ascending")])
    dims, parts = found["dim"].to_numpy(), found["part"].to_numpy()
    return {int(d): parts[dims == d] for d in np.unique(dims)}


def covariance(vectors: DataFrame, column: str, counts: dict[int, int], centred: Callable[[int, np.ndarray], np.ndarray], kind=np.int64) -> dict[int, np.ndarray]:
    """Weighted covariance, divisor the sum of weights, of ``centred(length, vectors)``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for d, x, w in by_length(batches, column, kind):
            c = centred(d, x)
            out[d] = out.get(d, 0.0) + (c * w[:, None]).T @ c
        return out

    return {d: m.reshape(int(round(m.size**0.5)), -1) / counts[d] for d, m in entry_sums(vectors, partial).items()}


def sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(sum of weights, exact weighted sums of entries) per length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for d, x, w in by_length(batches, "x"):
            n, s = found.get(d, (0, [0] * d))
            found[d] = (n + int(w.sum()), [a + b for a, b in zip(s, exactly(x, w), strict=True)])
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), pa.array([Decimal(v) for v in (n, *s)], pa.decimal128(38, 0))], ["dim", "entry", "part"])

    total = vectors.mapInArrow(run, "dim int, entry int, part decimal(38,0)").groupBy("dim", "entry").agg(F.sum("part").alias("part"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(total.collect(), key=lambda r: (r["dim"], r["entry"])):
        if r["entry"] < 0:
            out[r["dim"]] = (int(r["part"]), [])
        else:
            out[r["dim"]][1].append(int(r["part"]))
    return out


def apart(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where they hold it."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, s), default=0)
    return n * x - np.array(s, np.int64) if bound < LONG else n * x.astype(object) - np.array(s, object)


def deviations(e: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows of whole numbers, where a long holds them."""
    near = e.astype(np.float64)
    rough = (near * near).sum(axis=1)
    if e.dtype != object and (rough < LONG * 0.999).all():
        return (e * e).sum(axis=1).tolist()
    squares: list[int | None] = [None] * len(e)
    for i in np.flatnonzero(rough < LONG * 1.001).tolist():
        square = sum(int(v) ** 2 for v in e[i])
        squares[i] = square if square < LONG else None
    return squares


class Model:
    """Means and whitening directions of the vectors of one length."""

    def __init__(self, n: int, s: list[int], cov: np.ndarray, components: int):
        self.n, self.s = n, s
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        # Directions without variance, up to the rounding of the decomposition, cannot be scaled to one.
        floor = max(values[0], 0.0) * len(values) * 2.0**-50
        k = min(components, int((values > floor).sum()))
        lead = np.abs(vectors[:, :k]).argmax(axis=0)
        self.axes = vectors[:, :k] * np.where(vectors[lead, np.arange(k)] < 0, -1.0, 1.0) / np.sqrt(values[:k])
        self.explained = (values[:k] / np.trace(cov)).tolist() if k else []

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        e = apart(x, self.n, self.s)
        return e.astype(np.float64) / self.n @ self.axes, deviations(e)


def whitened(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 8, scale: int = 1024, shift: int = 100_000, weighted: bool = True) -> DataFrame:
    """key, n, deviation, whitened (array), explained (array), identity_error of every row whose vector can be used.

    Rows are left out whose vector is null or holds a null, an entry that isn't finite or one that is too large for a long. ``weighted``: a vector counts as often as it occurs; else
    each distinct one once. Each vector length has a fit of its own, as vectors of different lengths share no space. A fit has fewer than ``components``
    directions if its vectors vary in fewer; with one distinct vector, or none but empty ones, the arrays are empty and identity_error is 0. ``deviation`` is null where a
    long can't hold it. Null and repeated keys stay as they are; only the two named columns are read. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(key).alias("key"), whole(vector, scale, shift).alias("x")).where("x is not null")
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256)))
    weight = F.count("*") if weighted else F.lit(1).cast("long")
    distinct = stored(rows.groupBy("digest", "x").agg(weight.alias("weight")).withColumn("dim", F.size("x")), "whitening-vectors")
    total = sums(distinct)
    counts = {d: n for d, (n, _) in total.items()}
    cov = covariance(distinct, "x", counts, lambda d, x: apart(x, *total[d]).astype(np.float64) / counts[d])
    models = {d: Model(n, s, cov.get(d, np.zeros((d, d))), components) for d, (n, s) in total.items() if d}
    fitted = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("dim"))
            for d in np.unique(lengths[lengths > 0]):
                some, model = batch.filter(pa.array(lengths == d)), fitted.value[int(d)]
                w, squares = model.whiten(matrix(some.column("x")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.reshape(-1)))
                yield pa.RecordBatch.from_arrays([some.column("digest"), some.column("weight"), some.column("dim"), pa.array(squares, pa.int64()), lists], ["digest", "weight", "dim", "deviation", "whitened"])

    once = stored(distinct.mapInArrow(run, "digest binary, weight long, dim int, deviation long, whitened array<double>"), "whitening-whitened")
    middle = entry_sums(once, _weighted_sums)
    middle = {d: m / counts[d] for d, m in middle.items()}
    checked = covariance(once.where(F.size("whitened") > 0), "whitened", counts, lambda d, x: x - middle[d], np.float64)
    facts = [(d, m.n, m.explained, float(np.abs(checked[d] - np.eye(len(checked[d]))).max()) if d in checked else 0.0) for d, m in models.items()]
    facts = spark.createDataFrame(facts, "dim int, n long, explained array<double>, identity_error double")
    # One row a vector length.
    once = once.join(F.broadcast(facts) if len(models) <= 100_000 else facts.hint("merge"), "dim").drop("weight")
    out = rows.select("key", "digest").join(once.hint("merge"), "digest")
    return out.select(F.col("key").alias(key), "n", "deviation", "whitened", "explained", "identity_error")


def _weighted_sums(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for d, x, w in by_length(batches, "whitened", np.float64):
        out[d] = out.get(d, 0.0) + w @ x
    return out


def component_rows(found: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row a component."""
    zipped = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c")
    return found.select(key, "n", "deviation", "identity_error", zipped).select(key, (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
