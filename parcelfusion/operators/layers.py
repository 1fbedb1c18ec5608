"""Buildings, reference layers and utilities against parcels.

Tables have the ``shape`` of their rows (see ``functions.shapes``), or a ``ring`` or ``line`` that it is made from. Rows without a shape meet nothing and
are near nothing; parcels without one keep their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.numbers import rounded
from .spatial_join import box_join, nearest, shaped

UTILITIES = ("Electricity", "Water", "Sewer", "Gas", "Telecom")


def boxed(df: DataFrame, key: str, shape: str, box: str, *others: str, by: float = 0.0) -> DataFrame:
    """key, the shape under another name, its box and other columns."""
    return shaped(df).select(key, *others, F.col("shape").alias(shape), S.bbox(F.col("shape"), by).alias(box))


def building_reference(buildings: DataFrame, reference: DataFrame) -> DataFrame:
    """building_id, status, iou, ref_id: the reference building of largest IoU; buildings without any stay."""
    pairs = box_join(boxed(buildings, "building_id", "b_shape", "b_box"), boxed(reference, "ref_id", "r_shape", "r_box"), "b_box", "r_box")
    pairs = pairs.withColumn("inter", S.intersection_area(F.col("b_shape"), F.col("r_shape")))
    pairs = pairs.where("inter > 0").withColumn("iou", F.col("inter") / (S.area(F.col("b_shape")) + S.area(F.col("r_shape")) - F.col("inter")) * 100.0)
    best = pairs.groupBy("building_id").agg(F.max(F.struct("iou", (-F.col("ref_id")).alias("minus"))).alias("best"))
    out = buildings.select("building_id").join(best.hint("merge"), "building_id", "left")
    iou = F.coalesce("best.iou", F.lit(0.0))
    status = F.when(iou >= 50, "MATCHED").when(iou >= 20, "PARTIAL").otherwise("UNMATCHED")
    return out.select("building_id", status.alias("status"), rounded(iou, 2).alias("iou"), (-F.col("best.minus")).alias("ref_id"))


def near_layers(parcels: DataFrame, layers: DataFrame, radius: float) -> DataFrame:
    """Pairs of parcels and layer features whose boxes come within ``radius``, with their distance (0 where they share a point)."""
    right = shaped(layers).withColumnRenamed("shape", "l_shape").withColumn("l_box", S.bbox(F.col("l_shape")))
    pairs = box_join(boxed(parcels, "parcel_id", "p_shape", "p_box", by=radius), right.drop("parcel_id"), "p_box", "l_box")
    return pairs.withColumn("distance", S.distance(F.col("p_shape"), F.col("l_shape")))


def nearest_features(parcels: DataFrame, features: DataFrame, farthest: float | None = None, centroids: bool = False) -> DataFrame:
    """parcel_id, distance of the nearest feature from the parcel, or between their centroids; parcels without a shape, or with no feature in reach, get no row."""
    if not centroids:
        left, right = boxed(parcels, "parcel_id", "p_shape", "p_box"), shaped(features).select(F.col("shape").alias("l_shape"), S.bbox(F.col("shape")).alias("l_box"), S.outermost(F.col("shape")).alias("l_spots"))
        return nearest(left, right, "parcel_id", S.distance(F.col("p_shape"), F.col("l_shape")), "p_box", "l_box", "l_spots", farthest)
    spot = lambda c: F.when(c["x"].isNotNull(), F.struct(c["x"].alias("minx"), c["y"].alias("miny"), c["x"].alias("maxx"), c["y"].alias("maxy")))
    left, right = shaped(parcels).select("parcel_id", spot(S.centroid(F.col("shape"))).alias("p_box")), shaped(features).select(S.centroid(F.col("shape")).alias("c")).select(spot(F.col("c")).alias("l_box"), F.array("c").alias("l_spots"))
    return nearest(left, right, "parcel_id", F.hypot(F.col("p_box.minx") - F.col("l_box.minx"), F.col("p_box.miny") - F.col("l_box.miny")), "p_box", "l_box", "l_spots", farthest)


def parcel_layers(parcels: DataFrame, buildings: DataFrame, layers: DataFrame) -> DataFrame:
    """parcel_id, buildings, road_m (0 where there are no roads), water, power: what shares a point with each parcel, or is nearest to it."""
    held = box_join(boxed(parcels, "parcel_id", "p_shape", "p_box"), boxed(buildings, "building_id", "b_shape", "b_box"), "p_box", "b_box")
    held = held.where(S.meets(F.col("p_shape"), F.col("b_shape"))).groupBy("parcel_id").agg(F.count("*").alias("buildings"))
    roads = nearest_features(parcels, layers.where("layer = 'road'")).withColumnRenamed("distance", "road_m")
    flag = lambda layer: F.max(F.when((F.col("layer") == layer) & (F.col("distance") == 0), 1).otherwise(0))
    met = near_layers(parcels, layers.where("layer in ('water', 'power')"), 0.0).groupBy("parcel_id").agg(flag("water").alias("water"), flag("power").alias("power"))
    out = parcels.select("parcel_id").join(held.hint("merge"), "parcel_id", "left").join(met.hint("merge"), "parcel_id", "left").join(roads.hint("merge"), "parcel_id", "left")
    flagged = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    return out.select("parcel_id", F.coalesce("buildings", F.lit(0)).alias("buildings"), rounded(F.coalesce("road_m", F.lit(0.0)), 2).alias("road_m"), flagged("water").alias("water"), flagged("power").alias("power"))


def parcel_utilities(parcels: DataFrame, utilities: DataFrame, within: float = 35.0, by_centroid: bool = True, farthest: float = 999.0, kinds: tuple[str, ...] = UTILITIES) -> DataFrame:
    """parcel_id, meets, near, counts, n_<kind>, utilities, nearest_m: the assets that share a point with each parcel or come within ``within``.

    ``meets`` and ``near`` are sorted types, of any kind; ``counts`` maps every type that is near to its number of assets, the n_ columns are those of ``kinds`` and ``utilities`` is
    their total. ``nearest_m`` is the distance of the nearest asset of all, between centroids or from the parcel itself; ``farthest`` where none is nearer or the parcel has no shape.
    """
    near = near_layers(parcels, utilities, within).where(F.col("distance") <= within)
    each = near.groupBy("parcel_id", "utility_type").agg(F.count("*").alias("n"), F.min("distance").alias("least"))
    pair = F.struct(F.col("utility_type").alias("key"), F.col("n").alias("value"))
    # A parcel's types are few.
    found = each.groupBy("parcel_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("least") == 0, F.col("utility_type")))).alias("meets"), F.array_sort(F.collect_set("utility_type")).alias("near"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("utility_type").isNotNull(), pair)))).alias("counts"),
    )
    far = nearest_features(parcels, utilities, farthest, by_centroid)
    out = parcels.select("parcel_id").join(found.hint("merge"), "parcel_id", "left").join(far.hint("merge"), "parcel_id", "left")
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    of = lambda k: F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0))
    total: Column = sum((of(k) for k in kinds), F.lit(0))
    return out.select(
        "parcel_id", text("meets"), text("near"), F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"), *[of(k).alias(f"n_{k.lower()}") for k in kinds], total.alias("utilities"),
        rounded(F.coalesce("distance", F.lit(farthest)), 1).alias("nearest_m"),
    )


def building_overlaps(buildings: DataFrame, parcels: DataFrame) -> DataFrame:
    """Pairs of buildings and parcels that share a point, with their common area."""
    pairs = box_join(boxed(buildings, "building_id", "b_shape", "b_box"), boxed(parcels, "parcel_id", "p_shape", "p_box"), "b_box", "p_box")
    pairs = pairs.withColumn("inter", S.intersection_area(F.col("b_shape"), F.col("p_shape")))
    return pairs.where((F.col("inter") > 0.000001) | S.meets(F.col("b_shape"), F.col("p_shape"))).select("building_id", "parcel_id", "inter", S.area(F.col("b_shape")).alias("b_area"))


def building_audit(buildings: DataFrame, parcels: DataFrame, extent: tuple[float, float, float, float], outside_most: float = 5.0) -> DataFrame:
    """Per building: primary parcel (largest overlap, then least id), inside and outside percent, encroached parcels, extent and rectangle tests, status and explanation.

    ``encroached``: the other parcels that share a point with the building. ``in_extent``: its centroid is inside ``extent``, or the two share a point. A building that
    overlaps no parcel is 100 % inside and no conflict. ``buildings``: building_id, shape or ring; ``parcels``: parcel_id and, for the explanation, full_survey.
    """
    pairs = building_overlaps(buildings, parcels)
    sized = F.when(F.col("inter") > 0.000001, F.struct(rounded(F.col("inter"), 6).alias("inter"), (-F.col("parcel_id")).alias("minus")))
    found = pairs.groupBy("building_id").agg(F.max(sized).alias("best"), F.collect_set("parcel_id").alias("met"))
    shape = F.col("shape")
    survey = parcels.select(F.col("parcel_id").alias("primary_id"), (F.col("full_survey") if "full_survey" in parcels.columns else F.lit(None).cast("string")).alias("survey_no"))
    out = shaped(buildings).select("building_id", "shape").join(found.hint("merge"), "building_id", "left").withColumn("primary_id", -F.col("best.minus"))
    out = out.join(survey.hint("merge"), "primary_id", "left")
    box, center, area = S.bbox(shape), S.centroid(shape), S.area(shape)
    inside = F.when((area > 0) & (F.col("best.inter") > 0), F.least(F.lit(100.0), F.col("best.inter") / area * 100.0)).otherwise(100.0)
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    x0, y0, x1, y1 = extent
    bounds = F.struct(F.lit("polygon").alias("kind"), F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))).alias("parts"))
    held = (center["x"] > extent[0]) & (center["y"] > extent[1]) & (center["x"] < extent[2]) & (center["y"] < extent[3])
    in_extent = F.when(shape.isNotNull(), held | S.meets(shape, bounds)).otherwise(False)
    others = F.coalesce(F.array_sort(F.array_except("met", F.array("primary_id"))), F.array().cast("array<bigint>"))
    rectangle = (F.size(S.vertices(shape)) == 4) & (F.abs(area - (box["maxx"] - box["minx"]) * (box["maxy"] - box["miny"])) < 1e-6)
    out = out.select(
        "building_id", F.col("primary_id").alias("parcel_id"), "survey_no", rounded(inside, 1).alias("inside_pct"), F.array_join(others.cast("array<string>"), ",").alias("encroached"), in_extent.alias("in_extent"), F.coalesce(rectangle, F.lit(False)).alias("rectangle"), rounded(area, 2).alias("area"),
    )
    out = out.withColumn("outside_pct", rounded(100.0 - F.col("inside_pct"), 1)).withColumn("conflict", F.col("outside_pct") > outside_most)
    out = out.withColumn("status", F.when(F.col("conflict"), "Boundary Conflict").otherwise("Within Parcel"))
    named = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default))
    text = F.format_string("Building %s situated in Parcel %s (%s). Area: %.2f m2. Inside: %.1f%%, Outside: %.1f%%. Status: %s.", F.col("building_id").cast("string"), named("parcel_id", "Unassigned"), named("survey_no", "N/A"), F.coalesce("area", F.lit(0.0)), "inside_pct", "outside_pct", "status")
    return out.withColumn("explanation", text)


def audit_summary(audit: DataFrame) -> DataFrame:
    """validated, in_extent, conflicts, contained: counts over an audit."""
    of = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return audit.agg(F.count("*").alias("validated"), of(F.col("in_extent")).alias("in_extent"), of(F.col("conflict")).alias("conflicts"), of(~F.col("conflict")).alias("contained"))


def plausible(detections: DataFrame) -> DataFrame:
    """Detections of a building's size and shape: area 15-1800, side at most 70, aspect at most 4.5, compactness at least .12."""
    shape = S.of_ring(F.col("ring")) if "shape" not in detections.columns else F.col("shape")
    box, area = S.bbox(shape), S.area(shape)
    w, h = box["maxx"] - box["minx"], box["maxy"] - box["miny"]
    ok = area.between(15.0, 1800.0) & (F.greatest(w, h) <= 70.0) & (F.greatest(w, h) <= 4.5 * F.least(w, h)) & (S.compactness(shape) >= 0.12)
    return detections.where(ok)
