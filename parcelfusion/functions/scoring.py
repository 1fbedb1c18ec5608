"""Match scores, hard limits, confidence and other decision rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import rounded

# Fixed values of the rules.
RELIABILITY = {"gnss": 0.97, "drone": 0.90, "revenue": 0.78, "legacy": 0.65}
WEIGHTS = {"geometry": 0.35, "area": 0.20, "centroid": 0.20, "attribute": 0.15, "proximity": 0.10}
MATCHED, REVIEW = 90.0, 75.0
TOLERANCE, SAMPLE_STEP = 1.5, 0.5
MAX_DEVIATION, MEAN_DEVIATION, AREA_DIFFERENCE, LEAST_IOU = 12.0, 4.5, 25.0, 65.0
GNSS_MARGIN, RADIUS = 0.75, 35.0
CAPPED, LEAST_SCORE = 65.0, 40.0
CENTROID_SCALE, CENTROID_SCALE_2 = 15.0, 50.0
GATE_HAUSDORFF, GATE_IOU, GATE_AREA = 25.0, 0.20, 0.50


def not_null(*columns: Column) -> Column:
    """Array of the columns that aren't null."""
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def area_match(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) > 0, rounded(F.least(a, b) / F.greatest(a, b) * 100, 1)).otherwise(0.0)


def area_difference(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) > 0, F.abs(a - b) / F.greatest(a, b) * 100).otherwise(0.0)


def centroid_match(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), rounded(100.0 - distance / CENTROID_SCALE * 100.0, 1))


def proximity_match(mean_deviation: Column) -> Column:
    return F.greatest(F.lit(0.0), rounded(100.0 - mean_deviation / RADIUS * 100.0, 1))


def gnss_status(inside_pct: Column) -> Column:
    return F.when(inside_pct.isNull(), "NO_DATA").when(inside_pct >= 90.0, "HIGH").when(inside_pct >= 50.0, "MEDIUM").otherwise("LOW")


def weighted_score(iou: Column, area: Column, centroid: Column, attribute: Column, proximity: Column) -> Column:
    w = WEIGHTS
    return rounded(w["geometry"] * iou + w["area"] * area + w["centroid"] * centroid + w["attribute"] * attribute + w["proximity"] * proximity, 1)


def hard_flags(max_dev: Column, mean_dev: Column, area_diff: Column, iou: Column, gnss_pct: Column) -> Column:
    """Names of the hard limits that a candidate breaks."""
    return not_null(
        F.when(max_dev > MAX_DEVIATION, "max_deviation"),
        F.when(mean_dev > MEAN_DEVIATION, "mean_deviation"),
        F.when(area_diff > AREA_DIFFERENCE, "area_difference"),
        F.when(iou < LEAST_IOU, "iou"),
        F.when(gnss_pct < 50.0, "gnss"),
    )


def capped(score: Column, flags: Column) -> Column:
    return F.when(F.size(flags) > 0, F.least(score, F.lit(CAPPED))).otherwise(score)


def confidence_class(score: Column, flags: Column) -> Column:
    return F.when((F.size(flags) > 0) | (score < REVIEW), "Conflict").when(score >= MATCHED, "Matched").otherwise("Review")


def grade(passes: Column, warns: Column) -> Column:
    return F.when(passes, "PASS").when(warns, "WARN").otherwise("FAIL")


def checklist(iou: Column, area_diff: Column, mean_dev: Column, conformance: Column, gnss_pct: Column, attribute: Column, legacy: Column, drone: Column) -> Column:
    """Six graded lines: overlap, area, boundary, gnss, attribute, drone."""
    change = rounded(F.abs(legacy - drone) / F.greatest(legacy, F.lit(1.0)) * 100.0, 1)
    lines = {
        "overlap": (grade(iou >= 80, iou >= 50), F.format_string("IoU %.1f%%", rounded(iou, 1))),
        "area": (grade(area_diff <= 5, area_diff <= 15), F.format_string("area differs by %.1f%%", rounded(area_diff, 1))),
        "boundary": (grade((mean_dev <= 1) & (conformance >= 90), mean_dev <= 3), F.format_string("mean deviation %.2f m, %.1f%% conform", mean_dev, conformance)),
        "gnss": (F.when(gnss_pct.isNull(), "INFO").when(gnss_pct >= 90, "PASS").otherwise("FAIL"), F.when(gnss_pct.isNull(), "no survey points").otherwise(F.format_string("%.1f%% of points inside", gnss_pct))),
        "attribute": (grade(attribute >= 95, attribute >= 75), F.format_string("survey number agrees by %.0f%%", attribute)),
        "drone": (grade(change <= 1, change < 15), F.format_string("drone area changes by %.1f%%", change)),
    }
    return F.array(*[F.struct(F.lit(k).alias("line"), s.alias("status"), t.alias("text")) for k, (s, t) in lines.items()])


def second_score(iou: Column, area_ratio: Column, distance: Column, attributes: Column) -> Column:
    """The second scorer's base, 0 to 1; iou is a fraction."""
    near = F.greatest(F.lit(0.0), 1.0 - distance / CENTROID_SCALE_2)
    w = WEIGHTS
    return iou * w["geometry"] + area_ratio * w["area"] + near * w["centroid"] + attributes * w["attribute"] + near * w["proximity"]


def second_modifier(hausdorff: Column, vertices: Column, gnss: Column, utility: Column) -> Column:
    return (
        F.when(hausdorff < 2, 0.03).when(hausdorff > 15, -0.04).otherwise(0.0)
        + F.when(vertices > 0.85, 0.02).otherwise(0.0)
        + F.when(gnss, 0.03).otherwise(0.0)
        + F.when(utility, -0.05).otherwise(0.0)
    )


def gates(iou: Column, hausdorff: Column, area_ratio: Column) -> Column:
    return not_null(F.when(iou < GATE_IOU, "iou"), F.when(hausdorff > GATE_HAUSDORFF, "hausdorff"), F.when(1.0 - area_ratio > GATE_AREA, "area"))


def second_decision(confidence: Column, failed: Column) -> Column:
    return (
        F.when(F.size(failed) > 0, "REJECTED_BY_HARD_GATE")
        .when(confidence >= 0.85, "AUTO_MATCH_RECOMMENDED")
        .when(confidence >= 0.65, "MANUAL_ADJUDICATION_REQUIRED")
        .otherwise("LOW_CONFIDENCE_MATCH")
    )


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "HIGH").when(confidence >= 0.65, "MEDIUM").otherwise("LOW")


def reasons(iou: Column, area_ratio: Column, gnss: Column, utility: Column, failed: Column) -> Column:
    """One text of why a candidate was scored as it was."""
    parts = not_null(
        F.when(iou >= 0.8, "Boundaries align well.").when(iou >= 0.5, "Boundaries overlap in part.").otherwise("Boundaries hardly overlap."),
        F.when(area_ratio >= 0.9, "Areas agree.").otherwise("Areas differ."),
        F.when(gnss, "Survey points confirm it."),
        F.when(utility, "A utility corridor crosses it."),
        F.when(F.size(failed) > 0, F.concat(F.lit("Fails: "), F.array_join(failed, ", "), F.lit("."))),
    )
    return F.array_join(parts, " ")


def confidence_parts(overall: Column, geometry: Column, centroid: Column, attribute: Column, proximity: Column, area: Column, issues: Column, attribute_conf: Column, extraction: float = 95.0, change: float = 95.0) -> Column:
    """Eight-part confidence."""
    spatial = rounded(overall, 1)
    geom = rounded(0.6 * geometry + 0.4 * centroid, 1)
    attr = rounded(0.7 * attribute + 0.3 * attribute_conf, 1)
    source = rounded(0.5 * proximity + 0.5 * area, 1)
    topology = F.greatest(F.lit(40.0), 100.0 - issues * 15.0)
    whole = rounded(0.30 * spatial + 0.20 * geom + 0.20 * attr + 0.15 * source + 0.15 * topology, 1)
    named = {"spatial": spatial, "geometry": geom, "attribute": attr, "source": source, "topology": topology, "extraction": F.lit(extraction), "change_detection": F.lit(change), "overall": whole}
    return F.struct(*[c.alias(k) for k, c in named.items()])


def recommended_area(areas: dict[str, Column]) -> Column:
    """Mean of the known areas by the reliability of their sources; 0 counts as unknown."""
    known = {k: F.coalesce(c, F.lit(0.0)) for k, c in areas.items()}
    weight = lambda k: F.when(known[k] != 0, RELIABILITY[k]).otherwise(0.0)
    top = sum((known[k] * weight(k) for k in known), F.lit(0.0))
    return rounded(F.try_divide(top, sum((weight(k) for k in known), F.lit(0.0))), 1)


def geometry_source(n_points: Column, has_drone: Column) -> Column:
    return F.when(has_drone & (n_points >= 3), "GNSS + Drone geometry").when(has_drone, "Drone ORI Feature Extraction").otherwise("Legacy Cadastral (Pending Survey Verification)")


def conflict(legacy: Column, revenue: Column, drone: Column, has_drone: Column, feature_type: Column, iou: Column, centroid: Column, score: Column, rev_status: Column, rev_use: Column, use: Column) -> Column:
    """(rule, type, severity, confidence) of the first conflict rule that fits, else null."""
    kind = lambda rule, t, s, c: F.struct(F.lit(rule).alias("rule"), F.lit(t).alias("type"), s.alias("severity"), c.alias("confidence"))
    high, medium = F.lit("High"), F.lit("Medium")
    known = F.coalesce(revenue, F.lit(0.0)) != 0
    diverges = has_drone & (F.coalesce(drone, F.lit(0.0)) != 0) & (F.abs(drone - legacy) >= 35.0) & ((iou < 96.0) | (known & (F.abs(revenue - legacy) >= 25.0)))
    return (
        F.when(diverges, kind(0, "Geometry", high, score))
        .when(~has_drone, kind(1, "Missing", high, F.lit(35.0)))
        .when(F.contains(feature_type, F.lit("Plot Division")), kind(2, "Split", medium, F.lit(68.5)))
        .when(F.contains(feature_type, F.lit("Consolidated Compound")), kind(3, "Merge", medium, F.lit(71.0)))
        .when((iou < 85.0) | (centroid < 85.0), kind(4, "Geometry", F.when(iou < 60.0, "High").otherwise("Medium"), score))
        .when(known & (F.abs(legacy - revenue) / F.greatest(legacy, F.lit(1.0)) > 0.12), kind(5, "Area", medium, score))
        .when((F.coalesce(rev_status, F.lit("Active")) == "Disputed") | ((rev_use != "") & (use != "") & (rev_use != use)), kind(6, "Attribute", medium, score))
    )


def recommendation_case(gnss: Column, drone: Column, legacy: Column, score: Column, iou: Column, conflict_type: Column) -> Column:
    """Which of the six explanations a parcel gets."""
    known = lambda c: F.coalesce(c, F.lit(0.0)) != 0
    survey = known(gnss) & known(drone) & known(legacy) & (F.abs(gnss - drone) < 20.0) & (F.abs(legacy - drone) > 25.0)
    return (
        F.when(survey, "survey_agrees")
        .when(score >= MATCHED, "high_confidence")
        .when((conflict_type == "Geometry") | (iou < 75.0), "displaced")
        .when(conflict_type == "Area", "area_differs")
        .when(conflict_type == "Missing", "missing")
        .otherwise("candidate")
    )


def recommendation_text(case: Column, score: Column, iou: Column, revenue: Column, legacy: Column) -> Column:
    gap = F.abs(F.coalesce(revenue, F.lit(0.0)) - F.coalesce(legacy, F.lit(0.0)))
    return (
        F.when(case == "survey_agrees", "Survey points and drone boundary agree and differ from the legacy boundary; the surveyed geometry is recommended.")
        .when(case == "high_confidence", F.format_string("Sources agree (%.1f%% confidence).", score))
        .when(case == "displaced", F.format_string("The boundary is displaced (geometry agreement %.1f%%); verify in the field.", iou))
        .when(case == "area_differs", F.format_string("Register and polygon differ by %.1f m2; the drone extent is recommended until confirmed.", gap))
        .when(case == "missing", "No footprint was detected in the imagery; inspect on the ground.")
        .otherwise(F.format_string("Evidence gives %.1f%% confidence.", score))
    )
