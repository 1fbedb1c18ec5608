"""Conflicts, reconciliation, confidence, change events, provenance and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.numbers import padded, rounded
from ..scratch import stored


def numbered(df: DataFrame, prefix: str, name: str, *order: str) -> DataFrame:
    """Adds sequential ids such as C-001.

    Rows are dealt out in ranges of ``order`` and numbered inside their range, behind the rows of the ranges before it; only
    the counts, one for each range, are added up in one task.
    """
    ranges = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    counts = ranges.groupBy("_range").count().select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    n = F.row_number().over(W.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return ranges.join(F.broadcast(counts), "_range").withColumn(name, F.concat(F.lit(f"{prefix}-"), padded(n, 3))).drop("_range", "_before")


def assessed(matched: DataFrame) -> DataFrame:
    """Adds conflict, status, geometry source, recommended area and explanation to matched parcels.

    Needs: area (recorded), land_use, d_area, d_feature_type, iou, centroid_pct, score, rev_*, n_points, gnss_area.
    """
    has = F.col("feature_id").isNotNull()
    iou, centroid = F.coalesce(rounded(F.col("iou"), 1), F.lit(0.0)), F.coalesce(F.col("centroid_pct"), F.lit(0.0))
    score = F.coalesce(F.col("score"), F.lit(0.0))
    found = S.conflict(
        F.col("area"), F.col("rev_area"), F.col("d_area"), has, F.coalesce(F.col("d_feature_type"), F.lit("")), iou, centroid, score, F.col("rev_status"), F.col("rev_land_use"), F.col("land_use")
    )
    df = matched.withColumn("conflict", found)
    status = F.when(F.col("conflict").isNotNull(), "Conflict").when(score >= S.MATCHED, "Matched").otherwise("Review")
    n = F.coalesce(F.col("n_points"), F.lit(0))
    areas = {"gnss": F.when(n >= 3, F.col("gnss_area")), "drone": F.col("d_area"), "revenue": F.col("rev_area"), "legacy": F.col("area")}
    case = S.recommendation_case(areas["gnss"], F.col("d_area"), F.col("area"), score, iou, F.col("conflict.type"))
    df = df.withColumns({"status": status, "geometry_source": S.geometry_source(n, has), "recommended_area": S.recommended_area(areas), "case": case})
    return df.withColumn("explanation", S.recommendation_text(F.col("case"), score, iou, F.col("rev_area"), F.col("area")))


def change_events(parcels: DataFrame) -> DataFrame:
    """Change events of assessed parcels, several per parcel: parcel_id, change_type, severity, magnitude.

    Needs: area, d_area, iou, centroid_pct, conflict.
    """
    drone = F.coalesce(F.col("d_area"), F.lit(0.0)) != 0
    event = lambda t, s, m: F.struct(F.lit(t).alias("change_type"), s.alias("severity"), m.cast("double").alias("magnitude"))
    iou, delta = rounded(F.col("iou"), 1), F.col("d_area") - F.col("area")
    split = F.coalesce(F.col("conflict.type") == "Split", F.lit(False))
    size = F.when(delta > 0, event("Area Expansion", F.lit("Medium"), rounded(F.abs(delta), 1))).otherwise(event("Area Reduction", F.lit("Medium"), rounded(F.abs(delta), 1)))
    events = S.not_null(
        F.when(drone & ((iou < 92.0) | (F.col("centroid_pct") < 92.0)), event("Boundary Shift", F.when(iou < 85.0, "High").otherwise("Medium"), rounded(F.abs(delta), 1))),
        F.when(F.col("conflict.type") == "Attribute", event("Land Use Conversion", F.lit("Medium"), F.lit(None))),
        F.when(split, event("Subdivision Division", F.lit("High"), F.col("area"))),
        F.when(~split & drone & (F.abs(delta) > 40.0), size),
    )
    return parcels.select("parcel_id", F.explode(events).alias("event")).select("parcel_id", "event.*")


# What a change's type holds under each filter tab.
TABS = {"All": [""], "New": ["new", "addition"], "Removed": ["removed", "demolished"], "Modified": ["shift", "boundary"], "Land Use": ["land", "use"]}


def filtered_changes(changes: DataFrame, tab: str) -> DataFrame:
    """The changes under a filter tab."""
    low, out = F.lower("change_type"), F.lit(False)
    for word in TABS[tab]:
        out = out | F.contains(low, F.lit(word))
    return changes.where(out)


def recorded_changes(parcels: DataFrame, buildings: DataFrame, least: float = 20.0) -> DataFrame:
    """Boundary shifts by recorded area difference, and new-building items: feature_id, survey_no, change_type, severity, previous_value, current_value, magnitude.

    ``parcels``: parcel_id, full_survey, area, area_delta; ``buildings``: building_id, area and, where known, building_type and survey_no. Values that are not recorded stay null.
    """
    of = lambda df, c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    shifted = parcels.where(F.col("area_delta") > least)
    shifts = shifted.select(
        F.col("parcel_id").cast("string").alias("feature_id"), of(shifted, "full_survey").alias("survey_no"), F.lit("Boundary Alignment Shift").alias("change_type"), F.lit("High").alias("severity"),
        F.format_string("Legacy Map Extent: %.1f m2", "area").alias("previous_value"), F.format_string("Drone/GNSS Survey Extent: %.1f m2 (+%.1f m2)", rounded(F.col("area") + F.col("area_delta"), 1), rounded(F.col("area_delta"), 1)).alias("current_value"), F.col("area_delta").alias("magnitude"),
    )
    new = buildings.select(
        F.col("building_id").cast("string").alias("feature_id"), of(buildings, "survey_no").alias("survey_no"), F.lit("New Building Construction").alias("change_type"), F.lit("Medium").alias("severity"), F.lit("Vacant Plot / Open Land").alias("previous_value"),
        F.concat(F.lit("New Structure ("), F.concat_ws(", ", of(buildings, "building_type"), F.format_string("%.1f m2", "area")), F.lit(")")).alias("current_value"), F.col("area").alias("magnitude"),
    )
    return shifts.unionByName(new)


def provenance(parcels: DataFrame) -> DataFrame:
    """parcel_id, decision text, and the steps that led to it."""
    text = F.when(F.col("status") == "Conflict", "Held for review: sources conflict").when(F.col("status") == "Matched", "Accepted: sources agree").otherwise("Queued for review")
    steps = F.concat(
        F.array(F.lit("harmonize attributes"), F.lit("match candidates")),
        F.when(F.col("feature_id").isNotNull(), F.array(F.concat(F.lit("chosen candidate "), F.col("feature_id")))).otherwise(F.array(F.lit("no candidate"))),
        F.when(F.col("conflict").isNotNull(), F.array(F.concat(F.lit("conflict "), F.col("conflict.type")))).otherwise(F.array().cast("array<string>")),
    )
    return parcels.select("parcel_id", text.alias("decision"), steps.alias("steps"))


def summary(parcels: DataFrame) -> DataFrame:
    """One row: total, matched, conflicts, review."""
    of = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return parcels.agg(F.count("*").alias("total"), of("Matched").alias("matched"), of("Conflict").alias("conflicts"), of("Review").alias("review"))


def evaluation(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Agreement and the usual precision, recall and F1 of "is a conflict", over parcels with a known truth.

    ``predicted``: parcel_id, is_conflict; ``truth``: parcel_id, true_conflict.
    """
    both = predicted.join(truth.hint("merge"), "parcel_id")
    of = lambda c: F.sum(F.when(c, 1).otherwise(0))
    p, t = F.col("is_conflict"), F.col("true_conflict")
    counts = both.agg(F.count("*").alias("total"), of(p == t).alias("correct"), of(p & t).alias("tp"), of(p & ~t).alias("fp"), of(~p & t).alias("fn"))
    share = lambda a, b: rounded(F.coalesce(F.try_divide(a, b), F.lit(0.0)) * 100.0, 2)
    total, correct = F.col("total"), F.col("correct")
    wrong = total - correct
    return counts.select(
        "*",
        share(correct, total).alias("agreement_precision"),
        share(total - wrong, total).alias("agreement_recall"),
        share(F.col("tp"), F.col("tp") + F.col("fp")).alias("true_precision"),
        share(F.col("tp"), F.col("tp") + F.col("fn")).alias("true_recall"),
        share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def multi_confidence(matched: DataFrame, issues: Column, attribute_conf: Column) -> DataFrame:
    """parcel_id and the eight confidences of matched parcels."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    parts = S.confidence_parts(zero("score"), rounded(zero("iou"), 1), zero("centroid_pct"), zero("attribute_pct"), zero("proximity_pct"), zero("area_pct"), issues, attribute_conf)
    return matched.select("parcel_id", parts.alias("c")).select("parcel_id", "c.*")
