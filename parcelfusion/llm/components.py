"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """Undirected links (a, b) -> (v, component) with component the smallest id reachable.

    Every vertex of a link gets a row. Each round maps a vertex to the smallest of itself and its neighbours
    and relabels the links by that map, which at least halves the vertices of each component, so rounds
    grow as the logarithm of its size. A hub's links are pre-aggregated, and the joins on it can be split.
    """
    links = stored(links.select("a", "b").where("a <> b"), "links")
    labels, live = None, links
    while True:
        both = live.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(live.select(F.col("b").alias("v"), F.col("a").alias("w")))
        least = stored(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p")), "least")
        # Two steps along the map at once.
        step = least.join(least.select(F.col("v").alias("p"), F.col("p").alias("q")).hint("merge"), "p").select("v", F.col("q").alias("p"))
        step = stored(step, "step")
        if labels is None:
            labels = step.withColumnRenamed("p", "component")
        else:
            moved = step.select(F.col("v").alias("component"), "p")
            labels = labels.join(moved.hint("merge"), "component", "left").select("v", F.coalesce("p", "component").alias("component"))
        labels = stored(labels, "labels")
        at_a, at_b = step.select(F.col("v").alias("a"), F.col("p").alias("x")), step.select(F.col("v").alias("b"), F.col("p").alias("y"))
        live = live.join(at_a.hint("merge"), "a").join(at_b.hint("merge"), "b").where("x <> y")
        live = stored(live.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if live.isEmpty():
            return labels
