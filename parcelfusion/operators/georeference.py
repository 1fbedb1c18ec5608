"""Georeferencing: an affine transform per map sheet by least squares, its residuals, and its use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded

TOLERANCE = 2.5


def affine_fit(points: DataFrame) -> DataFrame:
    """sheet_id, n, a..f of map_x = a x + b y + c and map_y = d x + e y + f; nulls if three points don't span a plane.

    Means and (co)variances, which Spark adds up about the mean and so keeps exact far from the origin, make 2 x 2 normal equations.
    """
    pairs = {"xx": ("img_x", "img_x"), "xy": ("img_x", "img_y"), "yy": ("img_y", "img_y"), "xu": ("img_x", "map_x"), "yu": ("img_y", "map_x"), "xv": ("img_x", "map_y"), "yv": ("img_y", "map_y")}
    means = {"mx": "img_x", "my": "img_y", "mu": "map_x", "mv": "map_y"}
    s = points.groupBy("sheet_id").agg(F.count("*").alias("n"), *[F.covar_pop(p, q).alias(k) for k, (p, q) in pairs.items()], *[F.avg(c).alias(k) for k, c in means.items()])
    c = F.col
    det = c("xx") * c("yy") - c("xy") * c("xy")
    solved = lambda top: F.when(F.abs(det) * F.pow(c("n"), 3) > 1e-6, F.try_divide(top, det))
    s = s.withColumns({
        "a": solved(c("xu") * c("yy") - c("yu") * c("xy")), "b": solved(c("yu") * c("xx") - c("xu") * c("xy")),
        "d": solved(c("xv") * c("yy") - c("yv") * c("xy")), "e": solved(c("yv") * c("xx") - c("xv") * c("xy")),
    })
    return s.select("sheet_id", "n", "a", "b", (c("mu") - c("a") * c("mx") - c("b") * c("my")).alias("c"), "d", "e", (c("mv") - c("d") * c("mx") - c("e") * c("my")).alias("f"))


def residuals(points: DataFrame, fit: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """sheet_id, n, rmse, mean_residual, max_residual, accepted."""
    both = points.join(fit.hint("merge"), "sheet_id").where("a is not null")
    dx = F.col("a") * F.col("img_x") + F.col("b") * F.col("img_y") + F.col("c") - F.col("map_x")
    dy = F.col("d") * F.col("img_x") + F.col("e") * F.col("img_y") + F.col("f") - F.col("map_y")
    r = both.withColumn("square", dx * dx + dy * dy).groupBy("sheet_id").agg(F.first("n").alias("n"), F.avg("square").alias("ms"), F.avg(F.sqrt("square")).alias("mean"), F.max("square").alias("most"))
    rmse = F.sqrt("ms")
    return r.select("sheet_id", "n", rounded(rmse, 4).alias("rmse"), rounded(F.col("mean"), 4).alias("mean_residual"), rounded(F.sqrt("most"), 4).alias("max_residual"), (rmse <= tolerance).alias("accepted"))


def to_map(points: DataFrame, fit: DataFrame) -> DataFrame:
    """Points (sheet_id, img_x, img_y, ...) with map coordinates x and y by their sheet's transform, null where it has none."""
    both = points.join(fit.select("sheet_id", "a", "b", "c", "d", "e", "f").hint("merge"), "sheet_id", "left")
    x = F.col("a") * F.col("img_x") + F.col("b") * F.col("img_y") + F.col("c")
    y = F.col("d") * F.col("img_x") + F.col("e") * F.col("img_y") + F.col("f")
    return both.select(*points.columns, x.alias("x"), y.alias("y"))
