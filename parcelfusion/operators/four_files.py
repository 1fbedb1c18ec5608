"""The four-file run: cadastral and drone GeoJSON, survey points and register as CSV, to reconciled parcels.

Files in degrees are projected to metres, all to one zone so that distances across a zone's edge hold; rings that cross themselves
are repaired before they are matched, and what cannot be repaired is matched without a shape and reported.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import shapes as S
from ..functions.numbers import rounded
from ..functions.scoring import LEAST_SCORE
from ..scratch import stored
from ..sources import readers as I
from . import matching as M
from . import reconcile as R
from . import topology as T

DEGREES = 4326


class Run(NamedTuple):
    """Tables of a run: reconciled parcels, and repairs of rings (parcel_id, original_wkt, repaired_wkt, outcome)."""

    parcels: DataFrame
    repairs: DataFrame


def projected(df: DataFrame, zone: int, precision: float | None = None) -> DataFrame:
    """Rows whose ``epsg`` is in degrees, with shape and ring in metres of the UTM zone; coordinates are whole multiples of ``precision`` if given."""
    snap = lambda c: c if precision is None else F.round(c / precision) * precision

    def to(p: Column) -> Column:
        at = G.to_utm(p["x"], p["y"], F.lit(zone))
        return G.point(snap(at["x"]), snap(at["y"]))

    degrees = F.col("epsg") == DEGREES
    return df.withColumns({"shape": F.when(degrees, S.moved(F.col("shape"), to)).otherwise(F.col("shape")), "ring": F.when(degrees, F.transform("ring", to)).otherwise(F.col("ring"))})


def zone_of(*tables: DataFrame) -> int | None:
    """The lowest UTM zone of the first positions of all shapes in degrees, or None without any."""
    first = None
    for df in tables:
        one = df.where(F.col("epsg") == DEGREES).select(F.get(S.vertices(F.col("shape")), F.lit(0)).alias("p"))
        first = one if first is None else first.unionByName(one)
    inside = F.col("p.x").between(-180, 179.999999) & F.col("p.y").between(-90, 90)
    return first.agg(F.min(F.when(inside, G.utm_zone(F.col("p.x"))))).first()[0]


def repaired_shapes(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the table with repaired shapes, or null ones that can't be repaired; key, original_wkt, repaired_wkt, outcome of those that crossed themselves)."""
    flagged = df.where(S.crosses_itself(F.col("shape"))).select(key, "shape")
    fixed = stored(T.repaired_polygons(flagged, key), "repaired")
    hit = fixed.select(key, F.lit(True).alias("_hit"), F.col("repaired").alias("_shape"))
    out = df.join(hit.hint("merge"), key, "left")
    shape = F.when(F.col("_hit"), F.col("_shape")).otherwise(F.col("shape"))
    ring = F.when(F.col("_hit"), F.get("_shape.parts", F.lit(0))).otherwise(F.col("ring"))
    out = out.withColumns({"shape": shape, "ring": ring}).drop("_hit", "_shape")
    return out, fixed.select(key, "original_wkt", S.wkt(F.col("repaired")).alias("repaired_wkt"), "outcome")


def reconcile_files(spark: SparkSession, legacy: str, drone: str, gnss: str, revenue: str, lines: bool = False, zone: int | None = None, precision: float | None = None) -> Run:
    """Reconciled parcels of four files. ``zone``: UTM zone, by default the lowest that occurs; ``precision``: grid of projected coordinates in metres.

    Parcels keep their row whatever they lack: without a shape they match nothing and are conflicts. Areas that files don't state are those of the projected shapes.
    """
    p, d = I.legacy_parcels(spark, legacy, lines), I.drone_features(spark, drone, lines)
    p, d = stored(p.withColumn("stated", I.prop("area").try_cast("double")), "run-legacy"), stored(d.withColumn("stated", I.prop("area").try_cast("double")), "run-drone")
    zone = zone or zone_of(p, d) or 43
    p, d = (stored(projected(t, zone, precision).drop("props", "crs", "epsg"), "run-projected") for t in (p, d))
    p, repairs = repaired_shapes(p, "parcel_id")
    d, more = repaired_shapes(d, "feature_id")
    p, d = (t.withColumn("area", F.coalesce("stated", rounded(S.area(F.col("shape")), 1))).drop("stated") for t in (p, d))
    g = I.gnss_points(spark, gnss)
    snap = lambda c: c if precision is None else F.round(c / precision) * precision
    at = G.to_utm(F.col("longitude"), F.col("latitude"), F.lit(zone))
    g = stored(g.select("point_id", "survey_no", "seq", snap(at["x"]).alias("x"), snap(at["y"]).alias("y"), "accuracy_m"), "run-gnss")
    r = stored(I.revenue_rows(spark, revenue), "run-revenue")
    p = M.with_gnss_key(stored(p, "run-parcels"), g)
    matched = M.revenue_lookup(M.best_matches(p, M.evidence(p, stored(d, "run-features"), g, best=LEAST_SCORE)), r).join(M.gnss_areas(g).hint("merge"), "gnss_key", "left")
    return Run(R.assessed(matched), repairs.withColumnRenamed("parcel_id", "id").unionByName(more.withColumnRenamed("feature_id", "id")))
