"""Registered queries of matching and reconciliation, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.numbers import rounded
from ..functions.text import attribute_agreement
from ..operators import matching as M
from ..operators import reconcile as R
from ..operators.spatial_join import candidates
from ..scratch import stored
from .fixtures import derived, sql_for


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [derived(spark, sf_dir, n) for n in names]


def _without_corners(df: DataFrame) -> DataFrame:
    """Without the columns that the ring repeats."""
    return df.drop(*[f"{c}{i}" for c in "xy" for i in range(1, 5)])


def scored(spark: SparkSession, sf_dir: str, **wanted) -> DataFrame:
    p, d, g = _tables(spark, sf_dir, "parcels", "drone", "gnss")
    return M.evidence(_without_corners(p), _without_corners(d), g, **wanted)


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d, g, r = _tables(spark, sf_dir, "parcels", "drone", "gnss", "revenue")
    p = M.with_gnss_key(p, g)
    with_register = M.revenue_lookup(M.best_matches(p, M.evidence(p, _without_corners(d), g, best=S.LEAST_SCORE)), r)
    return with_register.join(M.gnss_areas(g).hint("merge"), "gnss_key", "left")


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assessed(matched(spark, sf_dir))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = _tables(spark, sf_dir, "parcels", "drone")
    return candidates(p, d).select("parcel_id", "feature_id")


def pair_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = _tables(spark, sf_dir, "parcels", "drone")
    names = ["inter", "union_area", "iou", "coverage_source", "coverage_candidate"]
    return M.overlaps(M.spread(candidates(p, d))).select("parcel_id", "feature_id", *[rounded(F.col(c), 4).alias(c) for c in names])


EVIDENCE = ["area_pct", "area_diff", "centroid_dist", "centroid_pct", "mean_dev", "median_dev", "p90_dev", "p95_dev", "p99_dev", "max_dev", "hausdorff", "conformance", "gnss_pct", "gnss_state", "attribute_pct", "proximity_pct", "raw_score", "score", "rank"]


def match_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.ranked(scored(spark, sf_dir)).withColumn("area_diff", rounded(F.col("area_diff"), 4))
    return df.select("parcel_id", "feature_id", rounded(F.col("iou"), 4).alias("iou"), *EVIDENCE, F.array_join("flags", ",").alias("flags"))


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = _tables(spark, sf_dir, "parcels")
    best = M.best_matches(p, scored(spark, sf_dir, best=S.LEAST_SCORE))
    return best.select("parcel_id", "feature_id", "score", S.confidence_class(F.col("score"), F.col("flags")).alias("class"))


def runners_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ranked(scored(spark, sf_dir, scores=True)).where("rank between 2 and 3").select("parcel_id", "feature_id", "score", "rank")


def candidate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("rank", "feature_id", "score")
    df = M.ranked(scored(spark, sf_dir, scores=True)).groupBy("parcel_id").agg(F.array_sort(F.collect_list(item)).alias("audit"))
    text = F.transform("audit", lambda a: F.concat_ws(":", a["rank"].cast("string"), a["feature_id"], F.format_string("%.1f", a["score"])))
    return df.select("parcel_id", F.size("audit").cast("long").alias("candidates"), F.array_join(text, ";").alias("audit"))


def match_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.ranked(scored(spark, sf_dir, best=0.0)).where("rank = 1")
    c = F.col
    lines = S.checklist(c("iou"), c("area_diff"), c("mean_dev"), c("conformance"), c("gnss_pct"), c("attribute_pct"), rounded(c("p_area"), 2), rounded(c("q_area"), 2))
    return df.select("parcel_id", "feature_id", F.explode(lines).alias("l")).select("parcel_id", "feature_id", "l.line", "l.status", "l.text")


def second_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d, g = _tables(spark, sf_dir, "parcels", "drone", "gnss")
    pairs = M.measured_pairs(M.with_gnss_key(_without_corners(p), g), _without_corners(d), g)
    pairs = M.with_inside(pairs, M.inside_counts(pairs, g))
    support = F.coalesce(F.col("inside") / F.col("points") >= 0.9, F.lit(False))
    out = M.second_ranking(pairs, support, F.col("parcel_id") % 10 == 1, attribute_agreement([(F.col("full_survey"), F.col("d_survey_candidate"))]))
    return out.select(
        "parcel_id", "feature_id", rounded(F.col("base_score"), 4).alias("base_score"), rounded(F.col("confidence"), 4).alias("confidence"), rounded(F.col("hausdorff"), 2).alias("hausdorff"),
        rounded(F.col("vertices"), 3).alias("vertices"), rounded(F.col("compact_a"), 3).alias("compact_a"), rounded(F.col("compact_b"), 3).alias("compact_b"), F.array_join("failed", ",").alias("failed"), "decision", "tier", "reason",
    )


def revenue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = _tables(spark, sf_dir, "parcels", "revenue")
    return M.revenue_lookup(p, r).select("parcel_id", "rev_seq", "rev_owner_ref", "rev_area", "rev_land_use", "rev_status")


def gnss_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = _tables(spark, sf_dir, "parcels", "gnss")
    return M.with_gnss_key(p, g).join(M.gnss_areas(g).hint("merge"), "gnss_key", "left").select("parcel_id", F.coalesce("n_points", F.lit(0)).alias("n_points"), "gnss_area")


def reconciled_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(spark, sf_dir).select("parcel_id", "feature_id", "score", "status", "geometry_source", "recommended_area", "case", "explanation", F.col("conflict.type").alias("conflict_type"), F.col("conflict.severity").alias("severity"))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconciled(spark, sf_dir).where("conflict is not null").select("parcel_id", F.col("conflict.rule").alias("rule"), F.col("conflict.type").alias("conflict_type"), F.col("conflict.severity").alias("severity"), F.col("conflict.confidence").alias("confidence"))
    return R.numbered(found, "C", "conflict_id", "parcel_id")


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary(reconciled(spark, sf_dir))


def confidence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.multi_confidence(matched(spark, sf_dir), F.col("parcel_id") % 3, F.lit(100.0))


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.change_events(reconciled(spark, sf_dir))


def change_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda word: F.sum(F.when(F.contains(F.lower("change_type"), F.lit(word)), 1).otherwise(0)).alias(f"n_{word}")
    return change_events(spark, sf_dir).agg(F.count("*").alias("n_all"), has("shift"), has("land"), has("subdivision"), has("area"))


def change_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = stored(change_events(spark, sf_dir).select(F.col("parcel_id").cast("string").alias("feature_id"), "change_type").unionByName(recorded_changes(spark, sf_dir).select("feature_id", "change_type")), "changes")
    out = None
    for tab in R.TABS:
        one = R.filtered_changes(both, tab).select("feature_id", "change_type", F.lit(tab).alias("tab"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("tab", "change_type").agg(F.count("*").alias("n"))


def recorded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d, b = _tables(spark, sf_dir, "parcels", "drone", "buildings")
    both = p.join(d.select(F.col("parcel_key").alias("parcel_id"), F.col("area").alias("d_area")).hint("merge"), "parcel_id").withColumn("area_delta", rounded(F.abs(F.col("d_area") - F.col("area")), 1))
    return R.recorded_changes(both, b.withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y4") - F.col("y1"))))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.provenance(reconciled(spark, sf_dir)).select("parcel_id", "decision", F.array_join("steps", " > ").alias("steps"))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = reconciled(spark, sf_dir).select("parcel_id", F.col("conflict").isNotNull().alias("is_conflict"))
    (p,) = _tables(spark, sf_dir, "parcels")
    k = F.col("parcel_id")
    truth = p.select("parcel_id", ((k % 17 == 3) | (k % 23 == 5) | (k % 19 == 4) | (k % 29 == 7)).alias("true_conflict"))
    return R.evaluation(predicted, truth)


# The checking SQL. Each CTE adds to the one before; the arithmetic is written out on edges, pair by pair.
def rnd(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def edge_rows(table: str, key: str) -> str:
    parts = []
    for i in range(1, 5):
        j = i % 4 + 1
        parts.append(f"SELECT {key} AS id, {i} AS i, x{i} AS ax, y{i} AS ay, x{j} AS bx, y{j} AS by_ FROM {table}")
    return " UNION ALL ".join(parts)


def box(p: str) -> dict[str, str]:
    xs, ys = ", ".join(f"{p}.x{i}" for i in range(1, 5)), ", ".join(f"{p}.y{i}" for i in range(1, 5))
    return {"x0": f"least({xs})", "x1": f"greatest({xs})", "y0": f"least({ys})", "y1": f"greatest({ys})"}


def meets(p: str, q: str, by: float = 0.0) -> str:
    a, b = box(p), box(q)
    return f"{a['x0']} - {by} <= {b['x1']} AND {b['x0']} <= {a['x1']} + {by} AND {a['y0']} - {by} <= {b['y1']} AND {b['y0']} <= {a['y1']} + {by}"


def shoelace(p: str) -> str:
    return "abs(" + " + ".join(f"({p}.x{i} * {p}.y{i % 4 + 1} - {p}.x{i % 4 + 1} * {p}.y{i})" for i in range(1, 5)) + ") / 2"


CAND = f"""cand AS MATERIALIZED (SELECT parcel_id, feature_id, full_survey, survey_candidate, {shoelace("p")} AS pa, {shoelace("d")} AS qa FROM parcels p JOIN drone d ON {meets("p", "d", 35.0)}),
pe AS MATERIALIZED ({edge_rows("parcels", "parcel_id")}),
de AS MATERIALIZED ({edge_rows("drone", "feature_id")})"""
UNDER_FLAT = """CASE WHEN hi > lo THEN sgn * (hi - lo) * (e0 + e1 + f0 + f1 - CASE WHEN (e0 - f0) * (e1 - f1) >= 0 THEN abs(e0 - f0) + abs(e1 - f1)
  ELSE ((e0 - f0) * (e0 - f0) + (e1 - f1) * (e1 - f1)) / (abs(e0 - f0) + abs(e1 - f1)) END) / 4 ELSE 0 END"""


def inter_cte(name: str, pairs: str, left: str, right: str, a: str, b: str, till: str = "", on: str = "") -> str:
    """CTE ``name``(a, b, inter): overlap of pairs whose edges are in the CTEs ``left`` and ``right``, up to the x ``till``."""
    y = lambda g, x: f"{g}.ay + ({g}.by_ - {g}.ay) * (({x} - {g}.ax) / nullif({g}.bx - {g}.ax, 0))"
    lo, hi = "greatest(least(e.ax, e.bx), least(f.ax, f.bx))", f"least(greatest(e.ax, e.bx), greatest(f.ax, f.bx){', ' + till if till else ''})"
    return f"""{name} AS MATERIALIZED (
  SELECT {a}, {b}, greatest(0, sum({UNDER_FLAT})) AS inter FROM (
    SELECT c.{a}, c.{b}, {lo} AS lo, {hi} AS hi, {y("e", lo)} AS e0, {y("e", hi)} AS e1, {y("f", lo)} AS f0, {y("f", hi)} AS f1, CASE WHEN (e.bx < e.ax) = (f.bx < f.ax) THEN 1 ELSE -1 END AS sgn
    FROM {pairs} c JOIN {left} e ON e.id = c.{a}{on.format("e")} JOIN {right} f ON f.id = c.{b}{on.format("f")}) z GROUP BY ALL)"""


OVERLAP = f"""{inter_cte("ov", "cand", "pe", "de", "parcel_id", "feature_id")},
ovs AS MATERIALIZED (
  SELECT cand.*, inter, pa + qa - inter AS un, CASE WHEN pa + qa - inter > 0 THEN inter / (pa + qa - inter) * 100.0 ELSE 0 END AS iou, inter / pa * 100.0 AS cs, inter / qa * 100.0 AS cc
  FROM cand JOIN ov USING (parcel_id, feature_id))"""


def samples(name: str, edges: str) -> str:
    """CTE of points sampled along rings: id, px, py."""
    return f"""{name}_l AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS len FROM {edges}),
{name}_c AS (SELECT *, sum(len) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS till, sum(len) OVER (PARTITION BY id) AS whole FROM {name}_l),
{name}_g AS (SELECT *, greatest(CAST(0.2 AS DOUBLE), least(CAST(0.5 AS DOUBLE), whole / 20)) AS gap FROM {name}_c),
{name}_n AS (SELECT DISTINCT id, gap, greatest(20, floor(whole / gap))::INT AS n FROM {name}_g WHERE i = 4),
{name}_k AS (SELECT id, gap, unnest(range(n)) * gap AS at_ FROM {name}_n),
{name} AS MATERIALIZED (
  SELECT k.id, ax + (bx - ax) * ((at_ - (till - len)) / len) AS px, ay + (by_ - ay) * ((at_ - (till - len)) / len) AS py
  FROM {name}_k k JOIN {name}_c c ON c.id = k.id AND (at_ < till OR c.i = 4) AND (c.i = 1 OR at_ >= till - len))"""


DIST = """sqrt((px - ax - t * dx) * (px - ax - t * dx) + (py - ay - t * dy) * (py - ay - t * dy))"""


def nearest(points: str, edges: str, pkey: str, ekey: str, pairs: str = "cand") -> str:
    """Rows (parcel_id, feature_id, px, py, d): least distance of points from the other ring's edges."""
    return f"""SELECT parcel_id, feature_id, px, py, min({DIST}) AS d FROM (
  SELECT c.parcel_id, c.feature_id, px, py, ax, ay, bx - ax AS dx, by_ - ay AS dy,
         greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t
  FROM {pairs} c JOIN {points} s ON s.id = c.{pkey} JOIN {edges} e ON e.id = c.{ekey}) z GROUP BY ALL"""


PROFILE = f"""{samples("ps", "pe")},
{samples("ds", "de")},
pv AS (SELECT id, ax AS px, ay AS py FROM pe), dv AS (SELECT id, ax AS px, ay AS py FROM de),
dd AS MATERIALIZED (SELECT parcel_id, feature_id, d FROM ({nearest("ps", "de", "parcel_id", "feature_id")}) UNION ALL SELECT parcel_id, feature_id, d FROM ({nearest("ds", "pe", "feature_id", "parcel_id")})),
hd AS (SELECT parcel_id, feature_id, max(d) AS far FROM ({nearest("pv", "de", "parcel_id", "feature_id")} UNION ALL {nearest("dv", "pe", "feature_id", "parcel_id")}) GROUP BY ALL),
pr AS MATERIALIZED (
  SELECT parcel_id, feature_id, {rnd("avg(d)", 2)} AS mean_dev, {", ".join(f"{rnd(f'l[1 + floor(CAST({q} AS DOUBLE) * (n - 1))::INT]', 2)} AS {name}" for q, name in ((0.5, "median_dev"), (0.9, "p90_dev"), (0.95, "p95_dev"), (0.99, "p99_dev")))},
         {rnd("l[n]", 2)} AS max_dev, {rnd("close / n * 100.0", 1)} AS conformance
  FROM (SELECT parcel_id, feature_id, list(d ORDER BY d) AS l, count(*) AS n, sum((d <= 1.5)::INT)::DOUBLE AS close, avg(d) AS d FROM dd GROUP BY ALL) GROUP BY ALL)"""


def centroid_cte(name: str, edges: str) -> str:
    return f"""{name} AS (
  SELECT e.id, any_value(ox) + sum((ax - ox + bx - ox) * w) / (3 * sum(w)) AS gx, any_value(oy) + sum((ay - oy + by_ - oy) * w) / (3 * sum(w)) AS gy
  FROM (SELECT a.*, o.ox, o.oy, (ax - o.ox) * (by_ - o.oy) - (bx - o.ox) * (ay - o.oy) AS w FROM {edges} a JOIN (SELECT id, ax AS ox, ay AS oy FROM {edges} WHERE i = 1) o USING (id)) e GROUP BY e.id)"""


GNSS_KEY = "SELECT *, CASE WHEN full_survey IN (SELECT survey_no FROM gnss) THEN full_survey ELSE survey_no END AS gnss_key FROM parcels"
GNSS = f"""gp AS MATERIALIZED (SELECT row_number() OVER () AS pt, p.parcel_id, g.x AS px, g.y AS py FROM gnss g JOIN ({GNSS_KEY}) p ON p.gnss_key = g.survey_no),
gi AS (
  SELECT parcel_id, feature_id, pt, sum(CASE WHEN (ay > py) <> (by_ > py) AND px < ax + (py - ay) * (bx - ax) / (by_ - ay) THEN 1 ELSE 0 END) % 2 = 1 OR min({DIST}) < 0.75 AS ok FROM (
    SELECT c.parcel_id, c.feature_id, pt, px, py, ax, ay, bx, by_, bx - ax AS dx, by_ - ay AS dy, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t
    FROM cand c JOIN gp USING (parcel_id) JOIN de e ON e.id = c.feature_id) z GROUP BY ALL),
gc AS MATERIALIZED (SELECT parcel_id, feature_id, count(*) AS points, sum(ok::INT) AS inside FROM gi GROUP BY ALL)"""


def norm(x: str) -> str:
    return f"regexp_replace(replace(trim({x}), ' ', ''), '(^|/)0+([^/])', '\\1\\2', 'g')"


SCORED = f"""{centroid_cte("pcen", "pe")},
{centroid_cte("dcen", "de")},
m0 AS (
  SELECT o.*, {rnd("o.pa", 2)} AS pa2, {rnd("o.qa", 2)} AS qa2, {rnd("sqrt((a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy))", 2)} AS centroid_dist, pr.* EXCLUDE (parcel_id, feature_id), {rnd("hd.far", 2)} AS hausdorff,
         {rnd("gc.inside / gc.points * 100.0", 1)} AS gnss_pct, {norm("full_survey")} AS na, {norm("survey_candidate")} AS nb
  FROM ovs o JOIN pcen a ON a.id = o.parcel_id JOIN dcen b ON b.id = o.feature_id JOIN pr USING (parcel_id, feature_id) JOIN hd USING (parcel_id, feature_id) LEFT JOIN gc USING (parcel_id, feature_id)),
m1 AS (
  SELECT *, {rnd("least(pa2, qa2) / greatest(pa2, qa2) * 100", 1)} AS area_pct, abs(pa2 - qa2) / greatest(pa2, qa2) * 100 AS area_diff, greatest(0, {rnd("100.0 - centroid_dist / 15.0 * 100.0", 1)}) AS centroid_pct,
         greatest(0, {rnd("100.0 - mean_dev / 35.0 * 100.0", 1)}) AS proximity_pct, CASE WHEN na = nb THEN 100.0 WHEN split_part(na, '/', 1) = split_part(nb, '/', 1) THEN 80.0 ELSE 20.0 END::DOUBLE AS attribute_pct,
         CASE WHEN gnss_pct IS NULL THEN 'NO_DATA' WHEN gnss_pct >= 90 THEN 'HIGH' WHEN gnss_pct >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS gnss_state
  FROM m0),
m2 AS (
  SELECT *, {rnd("0.35::DOUBLE * iou + 0.2::DOUBLE * area_pct + 0.2::DOUBLE * centroid_pct + 0.15::DOUBLE * attribute_pct + 0.1::DOUBLE * proximity_pct", 1)} AS raw_score,
         concat_ws(',', CASE WHEN max_dev > 12 THEN 'max_deviation' END, CASE WHEN mean_dev > 4.5 THEN 'mean_deviation' END, CASE WHEN area_diff > 25 THEN 'area_difference' END, CASE WHEN iou < 65 THEN 'iou' END, CASE WHEN gnss_pct < 50 THEN 'gnss' END) AS flags
  FROM m1),
m3 AS (SELECT *, CASE WHEN flags <> '' THEN least(raw_score, 65) ELSE raw_score END AS score FROM m2),
m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY score DESC, {rnd("iou", 1)} DESC, feature_id) AS rank FROM m3)"""

REGISTER = """k AS (SELECT *, CASE WHEN subdivision_no <> '' THEN survey_no || '/' || subdivision_no ELSE survey_no END AS full_survey FROM revenue),
kf AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY full_survey ORDER BY seq DESC) = 1),
kb AS (SELECT * FROM revenue QUALIFY row_number() OVER (PARTITION BY survey_no ORDER BY seq DESC) = 1),
reg AS (SELECT parcel_id, """ + ", ".join(f"CASE WHEN f.seq IS NOT NULL THEN f.{c} ELSE b.{c} END AS rev_{c}" for c in ("seq", "owner_ref", "area", "land_use", "status")) + """
  FROM parcels p LEFT JOIN kf f ON f.full_survey = p.full_survey LEFT JOIN kb b ON b.survey_no = p.survey_no)"""  # fmt: skip
RING = f"""go AS (SELECT survey_no, x, y, row_number() OVER w AS i, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM gnss WINDOW w AS (PARTITION BY survey_no ORDER BY seq, x, y)),
ga AS (SELECT survey_no, count(*) AS n_points, CASE WHEN count(*) >= 3 THEN {rnd("abs(sum(x * ny - nx * y)) / 2", 1)} END AS gnss_area FROM go GROUP BY survey_no)"""
ASSESSED = f"""a0 AS (
  SELECT p.parcel_id, p.area, p.land_use, b.feature_id, b.score, b.iou, b.centroid_pct, b.attribute_pct, b.proximity_pct, b.area_pct, d.area AS d_area, d.feature_type, r.* EXCLUDE (parcel_id), coalesce(ga.n_points, 0) AS n, ga.gnss_area,
         coalesce({rnd("b.iou", 1)}, 0) AS gm, coalesce(b.centroid_pct, 0) AS cm, coalesce(b.score, 0) AS sc
  FROM ({GNSS_KEY}) p LEFT JOIN (SELECT * FROM m WHERE rank = 1 AND score >= 40) b USING (parcel_id) LEFT JOIN drone d ON d.feature_id = b.feature_id JOIN reg r ON r.parcel_id = p.parcel_id LEFT JOIN ga ON ga.survey_no = p.gnss_key),
a1 AS (
  SELECT *, CASE WHEN feature_id IS NOT NULL AND d_area <> 0 AND abs(d_area - area) >= 35 AND (gm < 96 OR (coalesce(rev_area, 0) <> 0 AND abs(rev_area - area) >= 25)) THEN 0
    WHEN feature_id IS NULL THEN 1 WHEN contains(feature_type, 'Plot Division') THEN 2 WHEN contains(feature_type, 'Consolidated Compound') THEN 3 WHEN gm < 85 OR cm < 85 THEN 4
    WHEN coalesce(rev_area, 0) <> 0 AND abs(area - rev_area) / greatest(area, 1) > 0.12 THEN 5 WHEN coalesce(rev_status, 'Active') = 'Disputed' OR rev_land_use <> land_use THEN 6 END AS rule
  FROM a0),
a2 AS (
  SELECT *, CASE rule WHEN 0 THEN 'Geometry' WHEN 1 THEN 'Missing' WHEN 2 THEN 'Split' WHEN 3 THEN 'Merge' WHEN 4 THEN 'Geometry' WHEN 5 THEN 'Area' WHEN 6 THEN 'Attribute' END AS conflict_type,
         CASE WHEN rule IN (0, 1) OR (rule = 4 AND gm < 60) THEN 'High' WHEN rule IS NOT NULL THEN 'Medium' END AS severity, CASE rule WHEN 1 THEN 35.0 WHEN 2 THEN 68.5 WHEN 3 THEN 71.0 ELSE sc END AS confidence,
         CASE WHEN rule IS NOT NULL THEN 'Conflict' WHEN sc >= 90 THEN 'Matched' ELSE 'Review' END AS status, CASE WHEN n >= 3 THEN coalesce(gnss_area, 0) ELSE 0 END AS g, coalesce(d_area, 0) AS dr, coalesce(rev_area, 0) AS rv
  FROM a1),
a AS MATERIALIZED (
  SELECT *, CASE WHEN feature_id IS NOT NULL AND n >= 3 THEN 'GNSS + Drone geometry' WHEN feature_id IS NOT NULL THEN 'Drone ORI Feature Extraction' ELSE 'Legacy Cadastral (Pending Survey Verification)' END AS geometry_source,
    {rnd("(0.0::DOUBLE + g * (CASE WHEN g <> 0 THEN 0.97 ELSE 0 END)::DOUBLE + dr * (CASE WHEN dr <> 0 THEN 0.9 ELSE 0 END)::DOUBLE + rv * (CASE WHEN rv <> 0 THEN 0.78 ELSE 0 END)::DOUBLE + area * (CASE WHEN area <> 0 THEN 0.65 ELSE 0 END)::DOUBLE) / (0.0::DOUBLE + (CASE WHEN g <> 0 THEN 0.97 ELSE 0 END)::DOUBLE + (CASE WHEN dr <> 0 THEN 0.9 ELSE 0 END)::DOUBLE + (CASE WHEN rv <> 0 THEN 0.78 ELSE 0 END)::DOUBLE + (CASE WHEN area <> 0 THEN 0.65 ELSE 0 END)::DOUBLE)", 1)} AS recommended_area,
    CASE WHEN g <> 0 AND dr <> 0 AND area <> 0 AND abs(g - dr) < 20 AND abs(area - dr) > 25 THEN 'survey_agrees' WHEN sc >= 90 THEN 'high_confidence' WHEN conflict_type = 'Geometry' OR gm < 75 THEN 'displaced' WHEN conflict_type = 'Area' THEN 'area_differs' WHEN conflict_type = 'Missing' THEN 'missing' ELSE 'candidate' END AS "case"
  FROM a2)"""
EVENTS = f"""ev AS (
  SELECT parcel_id, 'Boundary Shift' AS change_type, CASE WHEN {rnd("iou", 1)} < 85 THEN 'High' ELSE 'Medium' END AS severity, {rnd("abs(d_area - area)", 1)} AS magnitude FROM a WHERE d_area <> 0 AND ({rnd("iou", 1)} < 92 OR centroid_pct < 92)
  UNION ALL SELECT parcel_id, 'Land Use Conversion', 'Medium', NULL FROM a WHERE conflict_type = 'Attribute'
  UNION ALL SELECT parcel_id, 'Subdivision Division', 'High', area FROM a WHERE conflict_type = 'Split'
  UNION ALL SELECT parcel_id, CASE WHEN d_area > area THEN 'Area Expansion' ELSE 'Area Reduction' END, 'Medium', {rnd("abs(d_area - area)", 1)} FROM a WHERE coalesce(conflict_type, '') <> 'Split' AND d_area <> 0 AND abs(d_area - area) > 40)"""
TO_SCORES = ",\n".join([CAND, OVERLAP, PROFILE, GNSS, SCORED])
TO_ASSESSED = ",\n".join([TO_SCORES, REGISTER, RING, ASSESSED])


def check(ctes: str, select: str, *names: str) -> str:
    return f"WITH {sql_for(*names)}{',' if ctes else ''}\n{ctes}\n{select}"


_M, _A = ("parcels", "drone", "gnss"), ("parcels", "drone", "gnss", "revenue")


def _checklist_sql() -> str:
    g = lambda a, b: f"CASE WHEN {a} THEN 'PASS' WHEN {b} THEN 'WARN' ELSE 'FAIL' END"
    change = rnd("abs(pa2 - qa2) / greatest(pa2, 1) * 100.0", 1)
    lines = {
        "overlap": (g("iou >= 80", "iou >= 50"), f"printf('IoU %.1f%%', {rnd('iou', 1)})"), "area": (g("area_diff <= 5", "area_diff <= 15"), f"printf('area differs by %.1f%%', {rnd('area_diff', 1)})"),
        "boundary": (g("mean_dev <= 1 AND conformance >= 90", "mean_dev <= 3"), "printf('mean deviation %.2f m, %.1f%% conform', mean_dev, conformance)"),
        "gnss": ("CASE WHEN gnss_pct IS NULL THEN 'INFO' WHEN gnss_pct >= 90 THEN 'PASS' ELSE 'FAIL' END", "CASE WHEN gnss_pct IS NULL THEN 'no survey points' ELSE printf('%.1f%% of points inside', gnss_pct) END"),
        "attribute": (g("attribute_pct >= 95", "attribute_pct >= 75"), "printf('survey number agrees by %.0f%%', attribute_pct)"), "drone": (g(f"{change} <= 1", f"{change} < 15"), f"printf('drone area changes by %.1f%%', {change})"),
    }
    return check(TO_SCORES, " UNION ALL ".join(f"SELECT parcel_id, feature_id, '{k}' AS line, {v} AS status, {t} AS text FROM m WHERE rank = 1" for k, (v, t) in lines.items()), *_M)


def _second_sql() -> str:
    perimeter = lambda e: f"(SELECT id, sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) AS p FROM {e} GROUP BY id)"
    ctes = ",\n".join([CAND, OVERLAP, GNSS, centroid_cte("pcen", "pe"), centroid_cte("dcen", "de")]) + f""",
pv AS (SELECT id, ax AS px, ay AS py FROM pe), dv AS (SELECT id, ax AS px, ay AS py FROM de),
hd AS (SELECT parcel_id, feature_id, max(d) AS far FROM ({nearest("pv", "de", "parcel_id", "feature_id")} UNION ALL {nearest("dv", "pe", "feature_id", "parcel_id")}) GROUP BY ALL),
s0 AS (
  SELECT o.parcel_id, o.feature_id, iou / 100.0 AS i1, least(pa, qa) / greatest(pa, qa) AS ar, far, sqrt((a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy)) AS dist, 4 * pi() * pa / (x.p * x.p) AS ca, 4 * pi() * qa / (y.p * y.p) AS cb,
         coalesce(inside / points >= 0.9, false) AS gs, o.parcel_id % 10 = 1 AS uc, CASE WHEN full_survey = survey_candidate THEN 1.0 WHEN contains(survey_candidate, full_survey) OR contains(full_survey, survey_candidate) THEN 0.5 ELSE 0 END::DOUBLE AS ag
  FROM ovs o JOIN hd USING (parcel_id, feature_id) LEFT JOIN gc USING (parcel_id, feature_id) JOIN pcen a ON a.id = o.parcel_id JOIN dcen b ON b.id = o.feature_id JOIN {perimeter("pe")} x ON x.id = o.parcel_id JOIN {perimeter("de")} y ON y.id = o.feature_id),
s1 AS (SELECT *, i1 * 0.35::DOUBLE + ar * 0.2::DOUBLE + greatest(0, 1 - dist / 50.0) * 0.2::DOUBLE + ag * 0.15::DOUBLE + greatest(0, 1 - dist / 50.0) * 0.1::DOUBLE AS base,
  CASE WHEN far < 2 THEN 0.03 WHEN far > 15 THEN -0.04 ELSE 0 END::DOUBLE + 0.02::DOUBLE + CASE WHEN gs THEN 0.03 ELSE 0 END::DOUBLE + CASE WHEN uc THEN -0.05 ELSE 0 END::DOUBLE AS mod_,
  concat_ws(', ', CASE WHEN i1 < 0.2::DOUBLE THEN 'iou' END, CASE WHEN far > 25 THEN 'hausdorff' END, CASE WHEN 1 - ar > 0.5 THEN 'area' END) AS failed FROM s0),
s AS (SELECT *, least(0.99::DOUBLE, greatest(0.01::DOUBLE, base + mod_)) AS conf FROM s1)"""
    select = f"""SELECT parcel_id, feature_id, {rnd("base", 4)} AS base_score, {rnd("conf", 4)} AS confidence, {rnd("far", 2)} AS hausdorff, 1.0::DOUBLE AS vertices, {rnd("ca", 3)} AS compact_a, {rnd("cb", 3)} AS compact_b, replace(failed, ', ', ',') AS failed,
  CASE WHEN failed <> '' THEN 'REJECTED_BY_HARD_GATE' WHEN conf >= 0.85 THEN 'AUTO_MATCH_RECOMMENDED' WHEN conf >= 0.65 THEN 'MANUAL_ADJUDICATION_REQUIRED' ELSE 'LOW_CONFIDENCE_MATCH' END AS decision,
  CASE WHEN conf >= 0.85 THEN 'HIGH' WHEN conf >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
  concat_ws(' ', CASE WHEN i1 >= 0.8 THEN 'Boundaries align well.' WHEN i1 >= 0.5 THEN 'Boundaries overlap in part.' ELSE 'Boundaries hardly overlap.' END, CASE WHEN ar >= 0.9 THEN 'Areas agree.' ELSE 'Areas differ.' END,
    CASE WHEN gs THEN 'Survey points confirm it.' END, CASE WHEN uc THEN 'A utility corridor crosses it.' END, CASE WHEN failed <> '' THEN 'Fails: ' || failed || '.' END) AS reason FROM s"""
    return check(ctes, select, *_M)


def _confidence_sql() -> str:
    z = lambda c: f"coalesce({c}, 0)::DOUBLE"
    sp, ge = rnd(z("score"), 1), rnd(f"0.6::DOUBLE * gm + 0.4::DOUBLE * {z('centroid_pct')}", 1)
    at, so = rnd(f"0.7::DOUBLE * {z('attribute_pct')} + 0.3::DOUBLE * 100", 1), rnd(f"0.5 * {z('proximity_pct')} + 0.5 * {z('area_pct')}", 1)
    top = "greatest(40, 100.0 - (parcel_id % 3) * 15.0)::DOUBLE"
    inner = f"SELECT parcel_id, {sp} AS spatial, {ge} AS geometry, {at} AS attribute, {so} AS source, {top} AS topology FROM a"
    whole = rnd("0.3::DOUBLE * spatial + 0.2::DOUBLE * geometry + 0.2::DOUBLE * attribute + 0.15::DOUBLE * source + 0.15::DOUBLE * topology", 1)
    return check(TO_ASSESSED, f"SELECT *, 95.0::DOUBLE AS extraction, 95.0::DOUBLE AS change_detection, {whole} AS overall FROM ({inner})", *_A)


_EXPLAINED = """CASE "case" WHEN 'survey_agrees' THEN 'Survey points and drone boundary agree and differ from the legacy boundary; the surveyed geometry is recommended.'
  WHEN 'high_confidence' THEN printf('Sources agree (%.1f%% confidence).', sc) WHEN 'displaced' THEN printf('The boundary is displaced (geometry agreement %.1f%%); verify in the field.', gm)
  WHEN 'area_differs' THEN printf('Register and polygon differ by %.1f m2; the drone extent is recommended until confirmed.', abs(coalesce(rev_area, 0) - area))
  WHEN 'missing' THEN 'No footprint was detected in the imagery; inspect on the ground.' ELSE printf('Evidence gives %.1f%% confidence.', sc) END"""
_DELTA = rnd("abs(d.area - p.area)", 1)
_RECORDED = f"""SELECT parcel_id::VARCHAR AS feature_id, full_survey AS survey_no, 'Boundary Alignment Shift' AS change_type, 'High' AS severity, printf('Legacy Map Extent: %.1f m2', p.area) AS previous_value,
  printf('Drone/GNSS Survey Extent: %.1f m2 (+%.1f m2)', {rnd(f"p.area + {_DELTA}", 1)}, {_DELTA}) AS current_value, {_DELTA} AS magnitude FROM parcels p JOIN drone d ON d.parcel_key = p.parcel_id WHERE {_DELTA} > 20
UNION ALL SELECT building_id::VARCHAR, NULL, 'New Building Construction', 'Medium', 'Vacant Plot / Open Land', printf('New Structure (%.1f m2)', (x2 - x1) * (y4 - y1)), (x2 - x1) * (y4 - y1) FROM buildings"""
_TRUE = "(parcel_id % 17 = 3 OR parcel_id % 23 = 5 OR parcel_id % 19 = 4 OR parcel_id % 29 = 7)"
_SHARE = lambda x, y: rnd(f"coalesce({x}::DOUBLE / nullif({y}, 0), 0) * 100.0", 2)

QUERIES = {
    "candidate_pairs": (candidate_pairs, check(CAND, "SELECT parcel_id, feature_id FROM cand", "parcels", "drone")),
    "pair_overlap": (pair_overlap, check(f"{CAND},\n{OVERLAP}", "SELECT parcel_id, feature_id, " + ", ".join(f"{rnd(a, 4)} AS {b}" for a, b in (("inter", "inter"), ("un", "union_area"), ("iou", "iou"), ("cs", "coverage_source"), ("cc", "coverage_candidate"))) + " FROM ovs", "parcels", "drone")),
    "match_evidence": (match_evidence, check(TO_SCORES, f"SELECT parcel_id, feature_id, {rnd('iou', 4)} AS iou, {', '.join(rnd('area_diff', 4) + ' AS area_diff' if c == 'area_diff' else c for c in EVIDENCE)}, flags FROM m", *_M)),
    "best_match": (best_match, check(TO_SCORES, "SELECT p.parcel_id, feature_id, score, CASE WHEN flags <> '' OR score < 75 THEN 'Conflict' WHEN score >= 90 THEN 'Matched' WHEN score IS NOT NULL THEN 'Review' ELSE 'Review' END AS class FROM parcels p LEFT JOIN (SELECT * FROM m WHERE rank = 1 AND score >= 40) m ON m.parcel_id = p.parcel_id", *_M)),
    "runners_up": (runners_up, check(TO_SCORES, "SELECT parcel_id, feature_id, score, rank FROM m WHERE rank BETWEEN 2 AND 3", *_M)),
    "candidate_audit": (candidate_audit, check(TO_SCORES, "SELECT parcel_id, count(*) AS candidates, string_agg(rank || ':' || feature_id || ':' || printf('%.1f', score), ';' ORDER BY rank) AS audit FROM m GROUP BY parcel_id", *_M)),
    "match_checklist": (match_checklist, _checklist_sql()),
    "second_ranking": (second_ranking, _second_sql()),
    "revenue_lookup": (revenue_lookup, check(REGISTER, "SELECT * FROM reg", "parcels", "revenue")),
    "gnss_lookup": (gnss_lookup, check(RING, "SELECT parcel_id, coalesce(n_points, 0) AS n_points, gnss_area FROM (" + GNSS_KEY + ") p LEFT JOIN ga ON ga.survey_no = p.gnss_key", "parcels", "gnss")),
    "reconciled_parcels": (reconciled_parcels, check(TO_ASSESSED, 'SELECT parcel_id, feature_id, score, status, geometry_source, recommended_area, "case", conflict_type, severity, ' + _EXPLAINED + " AS explanation FROM a", *_A)),
    "conflicts": (conflicts, check(TO_ASSESSED, "SELECT 'C-' || CASE WHEN n_ < 1000 THEN lpad(n_::VARCHAR, 3, '0') ELSE n_::VARCHAR END AS conflict_id, parcel_id, rule, conflict_type, severity, confidence::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (ORDER BY parcel_id) AS n_ FROM a WHERE rule IS NOT NULL)", *_A)),
    "match_summary": (match_summary, check(TO_ASSESSED, "SELECT count(*) AS total, sum((status = 'Matched')::INT)::BIGINT AS matched, sum((status = 'Conflict')::INT)::BIGINT AS conflicts, sum((status = 'Review')::INT)::BIGINT AS review FROM a", *_A)),
    "confidence_parts": (confidence_parts, _confidence_sql()),
    "change_events": (change_events, check(f"{TO_ASSESSED},\n{EVENTS}", "SELECT * FROM ev", *_A)),
    "change_badges": (change_badges, check(f"{TO_ASSESSED},\n{EVENTS}", "SELECT count(*) AS n_all, " + ", ".join(f"sum(contains(lower(change_type), '{w}')::INT)::BIGINT AS n_{w}" for w in ("shift", "land", "subdivision", "area")) + " FROM ev", *_A)),
    "change_tabs": (change_tabs, check(f"{TO_ASSESSED},\n{EVENTS}, rc AS ({_RECORDED}), al AS (SELECT change_type FROM ev UNION ALL SELECT change_type FROM rc)", "SELECT tab, change_type, count(*) AS n FROM al, (VALUES ('All', '.*'), ('New', 'new|addition'), ('Removed', 'removed|demolished'), ('Modified', 'shift|boundary'), ('Land Use', 'land|use')) AS t(tab, pattern) WHERE regexp_matches(lower(change_type), pattern) GROUP BY ALL", *_A, "buildings")),
    "recorded_changes": (recorded_changes, check("", _RECORDED, "parcels", "drone", "buildings")),
    "provenance": (provenance, check(TO_ASSESSED, "SELECT parcel_id, CASE status WHEN 'Conflict' THEN 'Held for review: sources conflict' WHEN 'Matched' THEN 'Accepted: sources agree' ELSE 'Queued for review' END AS decision, concat_ws(' > ', 'harmonize attributes', 'match candidates', CASE WHEN feature_id IS NULL THEN 'no candidate' ELSE 'chosen candidate ' || feature_id END, 'conflict ' || conflict_type) AS steps FROM a", *_A)),
    "evaluation": (evaluation, check(f"{TO_ASSESSED},\nc AS (SELECT count(*) AS total, sum(((rule IS NOT NULL) = {_TRUE})::INT)::BIGINT AS correct, sum((rule IS NOT NULL AND {_TRUE})::INT)::BIGINT AS tp, sum((rule IS NOT NULL AND NOT {_TRUE})::INT)::BIGINT AS fp, sum((rule IS NULL AND {_TRUE})::INT)::BIGINT AS fn FROM a)",
        f"SELECT *, {_SHARE('correct', 'total')} AS agreement_precision, {_SHARE('correct', 'total')} AS agreement_recall, {_SHARE('tp', '(tp + fp)')} AS true_precision, {_SHARE('tp', '(tp + fn)')} AS true_recall, {_SHARE('(2 * tp)', '(2 * tp + fp + fn)')} AS f1 FROM c", *_A)),
}
