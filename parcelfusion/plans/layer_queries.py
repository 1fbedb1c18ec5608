"""Registered queries of topology, layers, sync, raster, georeferencing and harmonization, with their SQL."""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import shapes as S
from ..functions import text as X
from ..functions.numbers import rounded
from ..operators import georeference as Q
from ..operators import harmonize as H
from ..operators import layers as L
from ..operators import raster as P
from ..operators import sync as Y
from ..operators import topology as T
from ..operators.spatial_join import self_overlaps
from ..scratch import shared_path, stored
from .fixtures import derived
from .match_queries import box, centroid_cte, check, edge_rows, inter_cte, meets, rnd, shoelace

#: The map extent that building audits test against.
EXTENT = (0.0, 0.0, 4000.0, 700.0)


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    drone = derived(spark, sf_dir, "drone")
    return self_overlaps(drone.select(F.col("parcel_key").alias("parcel_id"), "ring"))


def parcel_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlapping(spark, sf_dir).select("a", "b", rounded(F.col("overlap"), 3).alias("overlap"))


OVERLAPS = f"""r AS (SELECT parcel_key AS k, * FROM drone), re AS MATERIALIZED ({edge_rows("r", "k")}),
rp AS (SELECT p.k AS a, d.k AS b, {shoelace("p")} AS area_a, {shoelace("d")} AS area_b FROM r p JOIN r d ON p.k < d.k AND {meets("p", "d")}),
{inter_cte("ri", "rp", "re", "re", "a", "b")},
ro AS MATERIALIZED (SELECT a, b, area_a, area_b, inter FROM rp JOIN ri USING (a, b) WHERE inter > 2)"""


def shared_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = T.shared_boundary(_overlapping(spark, sf_dir)).where("strategy <> 'BISECT'")
    decisions = _overlapping(spark, sf_dir).select("a", "b", F.when(F.col("a") % 3 == 0, "APPROVED").when(F.col("a") % 3 == 1, "REJECTED").otherwise("MAYBE").alias("decision"))
    return T.decided(proposals, decisions)


def bisected_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shared_boundary(_overlapping(spark, sf_dir)).where("strategy = 'BISECT'")


def _bisect_sql() -> str:
    """The half under the mid-line is the overlap summed up to it; across the other axis, with x and y exchanged."""
    a, b = box("p"), box("d")
    low, high = {c: f"greatest({a[c + '0']}, {b[c + '0']})" for c in "xy"}, {c: f"least({a[c + '1']}, {b[c + '1']})" for c in "xy"}
    wide = f"{high['x']} - {low['x']} >= {high['y']} - {low['y']}"
    ctes = f"""{OVERLAPS}, {centroid_cte("rc", "re")},
bp AS (SELECT ro.*, {wide} AS wide, CASE WHEN {wide} THEN ({low['x']} + {high['x']}) / 2 ELSE ({low['y']} + {high['y']}) / 2 END AS mid FROM ro JOIN r p ON p.k = a JOIN r d ON d.k = b),
be AS MATERIALIZED (SELECT id, true AS wide, ax, ay, bx, by_ FROM re UNION ALL SELECT id, false, ay, ax, by_, bx FROM re),
{inter_cte("bl", "bp", "be", "be", "a", "b", "c.mid", " AND {0}.wide = c.wide")},
bm AS (SELECT bp.*, CASE WHEN CASE WHEN wide THEN u.gx <= v.gx ELSE u.gy <= v.gy END THEN bp.inter - bl.inter ELSE bl.inter END AS mine FROM bp JOIN bl USING (a, b) JOIN rc u ON u.id = a JOIN rc v ON v.id = b)"""
    two = {"overlap": "inter", "a_before": "area_a", "b_before": "area_b", "a_after": "area_a - mine", "b_after": "area_b - (inter - mine)"}
    return check(ctes, f"SELECT a, b, 'BISECT' AS strategy, {', '.join(f'{rnd(x, 2)} AS {n}' for n, x in two.items())} FROM bm", "drone")


def _bowties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived(spark, sf_dir, "parcels")
    k = F.col("parcel_id")
    crossed = F.array(F.get("ring", F.lit(0)), F.get("ring", F.lit(2)), F.get("ring", F.lit(1)), F.get("ring", F.lit(3)))
    thin = F.transform("ring", lambda v, i: G.point(v["x"], F.when(i >= 2, F.get(F.col("ring"), F.lit(3) - i)["y"] + 0.125).otherwise(v["y"])))
    return p.select("parcel_id", F.when(k % 41 == 5, crossed).when(k % 43 == 6, thin).when(k % 47 == 7, F.lit(None)).otherwise(F.col("ring")).alias("ring"))


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir, "gnss").select("point_id", (F.col("x") / 20).alias("longitude"), (F.col("y") / 20).alias("latitude"))
    return T.validation_issues(_bowties(spark, sf_dir), _overlapping(spark, sf_dir), g).groupBy("source", "issue", "severity", "auto_fixed").agg(F.count("*").alias("n"))


def repaired_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.repaired(_bowties(spark, sf_dir))
    return out.select("parcel_id", "outcome", rounded(G.area(F.col("repaired")), 3).alias("area"))


def duplicate_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir, "drone").select(F.col("parcel_key").alias("parcel_id"), "ring")
    turned = d.where("parcel_id % 10 = 0").select((F.col("parcel_id") + 10_000_000).alias("parcel_id"), F.concat(F.slice("ring", 3, 2), F.slice("ring", 1, 2)).alias("ring"))
    return T.duplicates(d.unionByName(turned)).select("first_id", "n")


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.source_counts(**{n: derived(spark, sf_dir, n) for n in ("parcels", "drone", "gnss", "revenue")})


def building_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.building_reference(derived(spark, sf_dir, "buildings"), derived(spark, sf_dir, "reference_buildings"))


BUILDINGS = f"""be AS MATERIALIZED ({edge_rows("buildings", "building_id")}), fe AS MATERIALIZED ({edge_rows("reference_buildings", "ref_id")}),
bp AS (SELECT building_id, ref_id, {shoelace("p")} AS pa, {shoelace("d")} AS qa FROM buildings p JOIN reference_buildings d ON {meets("p", "d")}),
{inter_cte("bi", "bp", "be", "fe", "building_id", "ref_id")},
bb AS (SELECT building_id, ref_id, inter / (pa + qa - inter) * 100.0 AS iou, row_number() OVER (PARTITION BY building_id ORDER BY inter / (pa + qa - inter) * 100.0 DESC, ref_id) AS n FROM bp JOIN bi USING (building_id, ref_id) WHERE inter > 0)"""


def parcel_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parcel_layers(derived(spark, sf_dir, "parcels"), derived(spark, sf_dir, "buildings"), derived(spark, sf_dir, "layers"))


def parcel_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(L.parcel_utilities(derived(spark, sf_dir, "parcels"), _assets(spark, sf_dir)))


def parcel_utilities_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within 15 m, and the nearest asset from the parcel's boundary."""
    return _counted(L.parcel_utilities(derived(spark, sf_dir, "parcels"), _assets(spark, sf_dir), 15.0, by_centroid=False))


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and points; one in eleven has no shape."""
    u = derived(spark, sf_dir, "utilities")
    shape = F.when(F.col("x1").isNull(), None).when(F.col("kind") == "point", S.of_point(F.col("x1"), F.col("y1"))).otherwise(S.of_line(F.col("line")))
    return u.select("feature_id", "utility_type", shape.alias("shape"))


def _counted(found: DataFrame) -> DataFrame:
    each = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return found.withColumn("counts", F.array_join(each, ","))


def parcel_utilities_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = L.near_layers(derived(spark, sf_dir, "parcels"), derived(spark, sf_dir, "layers"), 15.0)
    return near.where("distance <= 15").select("parcel_id", "feature_id", "utility_type", rounded(F.col("distance"), 2).alias("distance"))


def _seg(p: str, q: str) -> str:
    """Distance of the point ``p`` (px, py) from the segment ``q`` (ax, ay, bx, by_)."""
    t = f"greatest(0, least(1, coalesce((({p}x - {q}ax) * ({q}bx - {q}ax) + ({p}y - {q}ay) * ({q}by_ - {q}ay)) / nullif(({q}bx - {q}ax) * ({q}bx - {q}ax) + ({q}by_ - {q}ay) * ({q}by_ - {q}ay), 0), 0)))"
    gx, gy = f"({p}x - ({q}ax + {t} * ({q}bx - {q}ax)))", f"({p}y - ({q}ay + {t} * ({q}by_ - {q}ay)))"
    return f"sqrt({gx} * {gx} + {gy} * {gy})"


def _turn(a: str, b: str, c: str) -> str:
    ax, ay, bx, by, cx, cy = *a.split("|"), *b.split("|"), *c.split("|")
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


_E1, _E2, _L1, _L2 = "e.ax|e.ay", "e.bx|e.by_", "l.x1|l.y1", "l.x2|l.y2"
_CROSS = (
    f"({_turn(_L1, _L2, _E1)} * {_turn(_L1, _L2, _E2)} <= 0 AND {_turn(_E1, _E2, _L1)} * {_turn(_E1, _E2, _L2)} <= 0 AND least(e.ax, e.bx) <= greatest(l.x1, l.x2) AND least(l.x1, l.x2) <= greatest(e.ax, e.bx)"
    " AND least(e.ay, e.by_) <= greatest(l.y1, l.y2) AND least(l.y1, l.y2) <= greatest(e.ay, e.by_))"
)


def lines_sql(radius: float, table: str = "layers", others: str = "l.layer, ") -> str:
    """CTE ln: parcels and lines of a table whose boxes come within ``radius``, with their distance and those from the centroid to the line and to its middle."""
    xs, ys = ", ".join(f"p.x{i}" for i in range(1, 5)), ", ".join(f"p.y{i}" for i in range(1, 5))
    line_to = lambda x, y: _seg("z.p", "z.").replace("z.px", x).replace("z.py", y).replace("z.ax", "l.x1").replace("z.ay", "l.y1").replace("z.bx", "l.x2").replace("z.by_", "l.y2")
    edge_to = lambda x, y: _seg("z.p", "z.").replace("z.px", x).replace("z.py", y).replace("z.", "e.")
    return f"""pe AS MATERIALIZED ({edge_rows("parcels", "parcel_id")}),
lp AS (SELECT p.parcel_id, l.* FROM parcels p JOIN {table} l ON least({xs}) - {radius} <= greatest(l.x1, l.x2) AND least(l.x1, l.x2) <= greatest({xs}) + {radius} AND least({ys}) - {radius} <= greatest(l.y1, l.y2) AND least(l.y1, l.y2) <= greatest({ys}) + {radius}),
lc AS (
  SELECT e.id, any_value(e.ox) + sum((e.ax - e.ox + e.bx - e.ox) * w) / (3 * sum(w)) AS gx, any_value(e.oy) + sum((e.ay - e.oy + e.by_ - e.oy) * w) / (3 * sum(w)) AS gy
  FROM (SELECT a.*, o.ox, o.oy, (a.ax - o.ox) * (a.by_ - o.oy) - (a.bx - o.ox) * (a.ay - o.oy) AS w FROM pe a JOIN (SELECT id, ax AS ox, ay AS oy FROM pe WHERE i = 1) o USING (id)) e GROUP BY e.id),
ln AS MATERIALIZED (
  SELECT l.parcel_id, l.feature_id, {others}l.utility_type, any_value(sqrt(((l.x1 + l.x2) / 2 - c.gx) * ((l.x1 + l.x2) / 2 - c.gx) + ((l.y1 + l.y2) / 2 - c.gy) * ((l.y1 + l.y2) / 2 - c.gy))) AS from_middle, any_value({line_to("c.gx", "c.gy")}) AS from_centroid,
         CASE WHEN bool_or({_CROSS}) OR sum(CASE WHEN (e.ay > l.y1) <> (e.by_ > l.y1) AND l.x1 < e.ax + (l.y1 - e.ay) * (e.bx - e.ax) / nullif(e.by_ - e.ay, 0) THEN 1 ELSE 0 END) % 2 = 1 THEN 0
              ELSE least(min({line_to("e.ax", "e.ay")}), min({edge_to("l.x1", "l.y1")}), min({edge_to("l.x2", "l.y2")})) END AS distance
  FROM lp l JOIN pe e ON e.id = l.parcel_id JOIN lc c ON c.id = l.parcel_id GROUP BY ALL)"""


def building_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.building_audit(derived(spark, sf_dir, "buildings"), derived(spark, sf_dir, "parcels"), EXTENT)
    return found.select("building_id", "parcel_id", "inside_pct", "outside_pct", "encroached", "in_extent", "rectangle", "conflict")


def building_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.audit_summary(building_audit(spark, sf_dir))


def touching(name: str, pairs: str, left: str, right: str, a: str, b: str) -> str:
    """CTE ``name``(a, b): pairs of quadrilaterals (edges in the CTEs ``left`` and ``right``) that share a point: edges meet, or one holds the other's first corner."""
    inside = lambda p, q: f"sum(CASE WHEN {p}.i = 1 AND ({q}.ay > {p}.ay) <> ({q}.by_ > {p}.ay) AND {p}.ax < {q}.ax + ({p}.ay - {q}.ay) * ({q}.bx - {q}.ax) / nullif({q}.by_ - {q}.ay, 0) THEN 1 ELSE 0 END) % 2 = 1"
    cross = _CROSS.replace("l.x1", "l.ax").replace("l.y1", "l.ay").replace("l.x2", "l.bx").replace("l.y2", "l.by_")
    return f"""{name} AS (SELECT {a}, {b} FROM {pairs} JOIN {left} e ON e.id = {a} JOIN {right} l ON l.id = {b} GROUP BY ALL HAVING bool_or({cross}) OR {inside("e", "l")} OR {inside("l", "e")})"""


AUDIT = f"""be AS MATERIALIZED ({edge_rows("buildings", "building_id")}), pe AS MATERIALIZED ({edge_rows("parcels", "parcel_id")}),
up AS (SELECT building_id, parcel_id FROM buildings p JOIN parcels d ON {meets("p", "d")}),
{inter_cte("ui", "up", "be", "pe", "building_id", "parcel_id")},
{touching("ut", "up", "be", "pe", "building_id", "parcel_id")},
uo AS (SELECT ut.building_id, ut.parcel_id, CASE WHEN inter > 0.000001 THEN inter END AS inter, row_number() OVER (PARTITION BY ut.building_id ORDER BY CASE WHEN inter > 0.000001 THEN {rnd("inter", 6)} END DESC NULLS LAST, ut.parcel_id) AS n FROM ut LEFT JOIN ui USING (building_id, parcel_id)),
ub AS (SELECT * FROM uo WHERE n = 1 AND inter IS NOT NULL),
ua AS (
  SELECT b.building_id, u.parcel_id, {rnd(f"CASE WHEN u.inter IS NULL THEN 100 ELSE least(100, {rnd('u.inter', 6)} / ((x2 - x1) * (y4 - y1)) * 100.0) END", 1)} AS inside_pct, coalesce(o.others, '') AS encroached,
         x1 <= {EXTENT[2]} AND x2 >= {EXTENT[0]} AND y1 <= {EXTENT[3]} AND y4 >= {EXTENT[1]} AS in_extent
  FROM buildings b LEFT JOIN ub u USING (building_id) LEFT JOIN (SELECT uo.building_id, string_agg(uo.parcel_id::VARCHAR, ',' ORDER BY uo.parcel_id) AS others FROM uo LEFT JOIN ub ON ub.building_id = uo.building_id AND ub.parcel_id = uo.parcel_id WHERE ub.parcel_id IS NULL GROUP BY uo.building_id) o USING (building_id)),
au AS (SELECT building_id, parcel_id, inside_pct, {rnd("100.0 - inside_pct", 1)} AS outside_pct, encroached, in_extent, true AS rectangle, {rnd("100.0 - inside_pct", 1)} > 5 AS conflict FROM ua)"""


def plausible_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.plausible(derived(spark, sf_dir, "detections")).select("building_id")


def lod1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = derived(spark, sf_dir, "buildings").withColumn("m", G.lod1(F.col("ring"), F.lit(430.0), (F.col("building_id") % 9 + 3).cast("double")))
    return b.select("building_id", "m.roof_elevation", "m.volume", F.element_at("m.roof", 3)["z"].alias("roof_z"), (F.col("m.roof_elevation") - 430.0).alias("stratum_height"))


def sync_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.changes(derived(spark, sf_dir, "snapshot_old"), derived(spark, sf_dir, "snapshot_new")).select("feature_id", "parcel_id", "change")


def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.change_summary(sync_changes(spark, sf_dir))


def sync_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived(spark, sf_dir, "parcels").select("parcel_id", F.lit("Matched").alias("status"))
    return Y.marked(p, sync_changes(spark, sf_dir).where("change = 'GEOMETRY_CHANGED'"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    return o.select(k.alias("run_id"), F.when(k % 3 == 0, "SYNC_REQUIRED").when(k % 3 == 1, "REVIEW_REQUIRED").otherwise("APPROVED").alias("status"), (k % 4).alias("n_changes"), (k % 5 == 0).alias("approved"), (k % 7).alias("version"))


def sync_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.transitions(_runs(spark, sf_dir))


def sync_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.approvals(_runs(spark, sf_dir)).select("run_id", "version", "description", "decision", F.array_join("steps", " > ").alias("steps"))


def sync_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("feature_id")
    ids = {"parcel_id": F.when(k % 3 == 1, "").when(k % 3 == 2, F.concat(F.lit("P"), k)), "survey_no": F.when(k % 4 != 0, F.concat(F.lit("S"), k)), "id": F.concat(F.lit("I"), k)}
    side = lambda name: derived(spark, sf_dir, name).select(*[c.alias(n) for n, c in ids.items()], "area", "owner", "geom_key")
    return Y.changes(side("snapshot_old"), side("snapshot_new")).select("feature_id", "change")


SYNC = """sc AS (
  SELECT feature_id, coalesce(n.parcel_id, o.parcel_id) AS parcel_id, CASE WHEN o.parcel_id IS NULL THEN 'ADDED' WHEN n.parcel_id IS NULL THEN 'REMOVED' WHEN o.geom_key <> n.geom_key THEN 'GEOMETRY_CHANGED' WHEN o.area <> n.area THEN 'AREA_CHANGED' WHEN o.owner <> n.owner THEN 'ATTRIBUTE_CHANGED' END AS change
  FROM snapshot_old o FULL JOIN snapshot_new n USING (feature_id)), sy AS (SELECT * FROM sc WHERE change IS NOT NULL)"""


def dataset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("dataset"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("id"))
    return Y.versions(o).select("dataset", "id", "version", "active")


def result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "value")
    current = e.where("seq % 2 = 0").groupBy("id").agg(F.max(F.struct("seq", "value")).alias("m")).select("id", "m.seq", "m.value")
    return Y.upsert(current, e.where("seq % 2 = 1"), "id", "seq")


def raster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.raster_stats(derived(spark, sf_dir, "dem"))


def raster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "dem-tiles")
    P.write_tiles(derived(spark, sf_dir, "dem"), path, 512.0)
    return P.tile_window(spark.read.parquet(path), (400.0, 40.0, 1600.0, 160.0), 512.0).groupBy("raster_id").agg(F.count("*").alias("n"))


def raster_zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.zonal(derived(spark, sf_dir, "parcels"), derived(spark, sf_dir, "dem"))


def raster_zonal_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.zonal_masked(derived(spark, sf_dir, "parcels"), derived(spark, sf_dir, "dem"), pitch=1.0)


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    cols = {"width": 500 + k % 7 * 311, "height": 400 + k % 5 * 420, "bands": 1 + k % 4, "res_x": (1 + k % 8) / 64, "unit": F.when(k % 6 == 0, "degree").otherwise("metre"), "crs": F.concat(F.lit("EPSG:3264"), (k % 3).cast("string")), "minx": (k * 97 % 20000).cast("double"), "miny": (k * 31 % 9000).cast("double")}
    h = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("raster_id"), *[c.alias(n) for n, c in cols.items()])
    return h.withColumn("maxx", F.col("minx") + F.col("width")).withColumn("maxy", F.col("miny") + F.col("height"))


HEADERS = """h AS (SELECT *, minx + width AS maxx, miny + height AS maxy FROM (SELECT s_suppkey AS raster_id, 500 + s_suppkey % 7 * 311 AS width, 400 + s_suppkey % 5 * 420 AS height, 1 + s_suppkey % 4 AS bands, (1 + s_suppkey % 8) / 64 AS res_x,
  CASE WHEN s_suppkey % 6 = 0 THEN 'degree' ELSE 'metre' END AS unit, 'EPSG:3264' || (s_suppkey % 3) AS crs, (s_suppkey * 97 % 20000)::DOUBLE AS minx, (s_suppkey * 31 % 9000)::DOUBLE AS miny FROM supplier))"""


def raster_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.registered(_headers(spark, sf_dir)).select("raster_id", "gsd_cm", "band_names")


def raster_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tiles(_headers(spark, sf_dir))


def raster_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.comparable(_headers(spark, sf_dir))


def _difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.epoch_difference(derived(spark, sf_dir, "pixels_1"), derived(spark, sf_dir, "pixels_2"))


def raster_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difference(spark, sf_dir).select("px_row", "px_col", "g1", "g2", "diff")


def raster_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.opened_closed(P.mask(_difference(spark, sf_dir)))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.regions(stored(raster_mask(spark, sf_dir), "mask"))


def change_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _regions(spark, sf_dir).groupBy("region").agg(F.count("*").alias("pixels"))
    return found.select(F.col("region.px_row").alias("region_row"), F.col("region.px_col").alias("region_col"), "pixels")


def change_region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.region_report(_regions(spark, sf_dir), _difference(spark, sf_dir), least=3)
    return found.select(F.col("region.px_row").alias("region_row"), F.col("region.px_col").alias("region_col"), "pixels", "area", "row_min", "row_max", "col_min", "col_max", "mean_1", "mean_2", "kind", "confidence")


_LUM = rnd("0.0::DOUBLE + 0.299::DOUBLE * b1 + 0.587::DOUBLE * b2 + 0.114::DOUBLE * b3", 6)
DIFF = f"""df AS MATERIALIZED (SELECT px_row, px_col, g1, g2, floor(abs(g1 - g2))::INT AS diff FROM (SELECT px_row, px_col, {_LUM} AS g1 FROM pixels_1) x JOIN (SELECT px_row, px_col, {_LUM} AS g2 FROM pixels_2) y USING (px_row, px_col)),
mk AS MATERIALIZED (SELECT px_row, px_col FROM df WHERE diff > 25), o AS (SELECT unnest([-1, 0, 1]) AS d)"""
_HOOD = "SELECT px_row + r.d AS px_row, px_col + c.d AS px_col FROM {} CROSS JOIN o r CROSS JOIN o c"
MORPH = f"""m1 AS MATERIALIZED (SELECT px_row, px_col FROM ({_HOOD.format("mk")}) GROUP BY ALL HAVING count(*) = 9), m2 AS MATERIALIZED (SELECT DISTINCT * FROM ({_HOOD.format("m1")})),
m3 AS (SELECT DISTINCT * FROM ({_HOOD.format("m2")})), m4 AS MATERIALIZED (SELECT px_row, px_col FROM ({_HOOD.format("m3")}) GROUP BY ALL HAVING count(*) = 9)"""
REGIONS = """rg AS (
  SELECT px_row, px_col, px_row * 4294967296 + px_col AS region FROM m4 UNION
  SELECT b.px_row, b.px_col, rg.region FROM rg JOIN m4 b ON abs(b.px_row - rg.px_row) <= 1 AND abs(b.px_col - rg.px_col) <= 1),
rr AS (SELECT px_row, px_col, min(region)::BIGINT AS region FROM rg GROUP BY ALL)"""
NAMED = "region // 4294967296 AS region_row, region % 4294967296 AS region_col"


def affine_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = derived(spark, sf_dir, "control_points")
    return Q.residuals(points, Q.affine_fit(points))


def affine_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = derived(spark, sf_dir, "control_points")
    return Q.to_map(points, Q.affine_fit(points)).select("point_id", rounded(F.col("x"), 3).alias("x"), rounded(F.col("y"), 3).alias("y"))


_AFFINE = """s AS (SELECT sheet_id, count(*) AS n, avg(img_x) AS mx, avg(img_y) AS my, avg(map_x) AS mu, avg(map_y) AS mv FROM control_points GROUP BY sheet_id),
c AS (SELECT p.*, n, img_x - mx AS x, img_y - my AS y, map_x - mu AS u, map_y - mv AS v FROM control_points p JOIN s USING (sheet_id)),
q AS (SELECT sheet_id, any_value(n) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * u) AS xu, sum(y * u) AS yu, sum(x * v) AS xv, sum(y * v) AS yv FROM c GROUP BY sheet_id),
f AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS d, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS e FROM q WHERE abs(n * (xx * yy - xy * xy)) > 1e-6),
r AS (SELECT sheet_id, point_id, f.n, power(a * x + b * y - u, 2) + power(d * x + e * y - v, 2) AS sq, map_x - u + a * x + b * y AS mx, map_y - v + d * x + e * y AS my FROM c JOIN f USING (sheet_id))"""


def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (72 + F.col("c_custkey") % 1000 / 125).alias("lon"), (F.col("c_custkey") % 77 - 30 + 0.25).alias("lat"))
    c = c.withColumn("zone", G.utm_zone(F.col("lon")))
    there = G.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    c = c.withColumn("m", there)
    back = F.when(F.col("lat") >= 0, G.from_utm(F.col("m.x"), F.col("m.y"), F.col("zone"))).otherwise(G.from_utm(F.col("m.x"), F.col("m.y"), F.col("zone"), north=False))
    c = c.withColumn("b", back)
    return c.select("c_custkey", "zone", G.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), rounded(F.col("m.x"), 0).alias("easting"), rounded(F.col("m.y"), 0).alias("northing"), rounded(F.col("b.x"), 6).alias("lon"), rounded(F.col("b.y"), 6).alias("lat"))


def _utm_sql() -> str:
    """The other way to project: powers of the longitude difference, and the meridian arc as a series in the eccentricity."""
    arc = "(1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * p - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * p) + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * p) - 35 * e2 * e2 * e2 / 3072 * sin(6 * p)"
    east = "v * (l + (1 - t + c) * l * l * l / 6 + (5 - 18 * t + t * t + 72 * c - 58 * s) * power(l, 5) / 120)"
    north = "6378137.0::DOUBLE * arc + v * tan(p) * (l * l / 2 + (5 - t + 9 * c + 4 * c * c) * power(l, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * s) * power(l, 6) / 720)"
    return f"""WITH k AS (SELECT c_custkey, 72 + c_custkey % 1000 / 125 AS lon, (c_custkey % 77 - 30 + 0.25)::DOUBLE AS lat, (2 / 298.257223563::DOUBLE - 1 / power(298.257223563::DOUBLE, 2)) AS e2 FROM customer),
z AS (SELECT *, (floor((lon + 180) / 6) + 1)::INT AS zone, radians(lat) AS p FROM k),
a AS (SELECT *, e2 / (1 - e2) AS s, {arc} AS arc, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(p) * sin(p)) AS v, tan(p) * tan(p) AS t, e2 / (1 - e2) * cos(p) * cos(p) AS c, radians(lon - (zone * 6 - 183)) * cos(p) AS l FROM z)
SELECT c_custkey, zone, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS epsg, {rnd(f"500000 + 0.9996::DOUBLE * ({east})", 0)} AS easting, {rnd(f"CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END + 0.9996::DOUBLE * ({north})", 0)} AS northing, {rnd("lon", 6)} AS lon, {rnd("lat", 6)} AS lat FROM a"""


def crs_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("dataset"), F.when(F.col("c_custkey") % 50 == 0, 200.0).otherwise(72 + F.col("c_nationkey") / 4 + F.col("c_custkey") % 8).alias("lon"), (F.col("c_custkey") % 60 - 20.0).alias("lat"))
    return H.crs_check(c)


VARIANTS = ["Survey No", "surveynum", "Owner Name", "Land-Use", "khata", "Total Area (sqm)", "remarks"]


def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in variants that carry the last digit of a source, as numbered columns do."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    variants = F.array(*[F.concat(F.lit(v), F.regexp_extract("source", "[0-9]$", 0)) for v in VARIANTS], F.lit("Plot_ID"), F.lit("AREA"))
    return H.header_mapping(d.select(F.explode(variants).alias("header")))


def _header_sql() -> str:
    """SQL has no such ratio: it joins a table of all the variants, filled by a plain loop."""
    keys = [(c, s, re.sub("[^a-z0-9]", "", s)) for c, ss in X.SYNONYMS.items() for s in ss]

    def plain(header: str) -> tuple:
        k = re.sub("[^a-z0-9]", "", header.strip().lower())
        for c in X.SYNONYMS:
            if k == c.replace("_", ""):
                return c, 100.0, "Exact Match"
        for c, _, s in keys:
            if k == s:
                return c, 96.0, "Synonym Dictionary"
        ratio, c = max(((SequenceMatcher(None, k, s).ratio(), c) for c, _, s in keys), key=lambda x: x[0])
        return (c, math.floor(ratio * 1000 + 0.5) / 10, "Fuzzy Match") if ratio >= X.FUZZY_LEAST else (None, 0.0, "Unmapped")

    text = lambda v: "NULL" if v is None else f"'{v}'"
    rows = [(h, *plain(h)) for h in [*(f"{v}{d}" for v in VARIANTS for d in ["", *range(10)]), "Plot_ID", "AREA"]]
    values = ", ".join(f"('{h}', {text(c)}, {x}::DOUBLE, '{m}')" for h, c, x, m in rows)
    made = " UNION ".join(f"SELECT '{v}' || regexp_extract(source, '[0-9]$') AS header FROM documents" for v in VARIANTS)
    return f"WITH h AS ({made} UNION SELECT 'Plot_ID' FROM documents UNION SELECT 'AREA' FROM documents) SELECT header, canonical, confidence, method FROM h LEFT JOIN (VALUES {values}) AS t(header, canonical, confidence, method) USING (header)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    entry = lambda name, c: F.struct(F.lit(name).alias("key"), c.cast("string").alias("value"))
    entries = [
        F.when(k % 4 != 0, entry("survey_number", F.concat(F.lit(" "), k, F.lit(" ")))), F.when(k % 3 == 0, entry("hissa_no", k % 9)), F.when(k % 5 == 1, entry("extent", F.lit("n/a"))), F.when(k % 2 == 0, entry("parcel_area", k % 500)),
        F.when(k % 6 == 2, entry("category", F.lit("AGRI"))), F.when(k % 6 == 3, entry("zoning", F.lit("green belt"))), F.when(k % 7 == 0, entry("khathedar", F.concat(F.lit("H"), k % 11))), F.when(k % 9 == 4, entry("gaothan", F.concat(F.lit(" V"), k % 13))), F.when(k % 10 == 3, entry("sector", k % 17)), entry("remark", F.col("o_orderpriority")),
    ]
    return o.select(k.alias("id"), F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("props"))


def harmonized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).select("id", H.harmonized_record(F.col("props")).alias("h"))
    return r.select("id", "h.survey_number", "h.subdivision_number", "h.full_survey", "h.area_m2", "h.land_use", "h.owner_ref", "h.village", "h.ward", "h.attribute_confidence", F.array_join("h.provenance", "; ").alias("provenance"), F.array_join(F.array_sort(F.map_keys("h.extension")), ",").alias("extension"))


HARMONIZED = r"""SELECT id, survey_number, subdivision_number, survey_number || '/' || subdivision_number AS full_survey, area_m2, land_use, owner_ref, village, ward, attribute_confidence, provenance, extension FROM (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey::VARCHAR ELSE '100' END AS survey_number, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 9)::VARCHAR ELSE '1' END AS subdivision_number,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 500 ELSE 1000 END::DOUBLE AS area_m2, CASE WHEN o_orderkey % 6 = 2 THEN 'Agricultural' WHEN o_orderkey % 6 = 3 THEN 'Green Belt' ELSE 'Residential' END AS land_use,
    CASE WHEN o_orderkey % 7 = 0 THEN 'H' || (o_orderkey % 11) END AS owner_ref, CASE WHEN o_orderkey % 9 = 4 THEN 'V' || (o_orderkey % 13) END AS village, CASE WHEN o_orderkey % 10 = 3 THEN (o_orderkey % 17)::VARCHAR END AS ward, CASE WHEN o_orderkey % 4 <> 0 THEN 100.0 ELSE 80.0 END::DOUBLE AS attribute_confidence,
    concat_ws('; ', CASE WHEN o_orderkey % 4 <> 0 THEN 'survey_number -> survey_number' END, CASE WHEN o_orderkey % 3 = 0 THEN 'hissa_no -> subdivision_number' END, CASE WHEN o_orderkey % 2 = 0 THEN 'parcel_area -> area_m2' END,
      CASE WHEN o_orderkey % 6 = 2 THEN 'category -> land_use' WHEN o_orderkey % 6 = 3 THEN 'zoning -> land_use' END) AS provenance,
    concat_ws(',', CASE WHEN o_orderkey % 5 = 1 THEN 'extent' END, CASE WHEN o_orderkey % 9 = 4 THEN 'gaothan' END, 'remark', CASE WHEN o_orderkey % 10 = 3 THEN 'sector' END) AS extension FROM orders)"""


def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows under other headers: the headers, a handful, are mapped first, then the columns."""
    r = derived(spark, sf_dir, "revenue").select("seq", F.col("survey_no").alias("Khasra No"), F.col("subdivision_no").alias("Sub Division"), F.col("owner_ref").alias("holder_name"), F.col("area").alias("Total-Area"), F.col("owner_ref").alias("Proprietor"))
    headers = spark.createDataFrame([(c,) for c in r.columns], "header string")
    mapping = {x["header"]: x["canonical"] for x in H.header_mapping(headers).collect() if x["canonical"]}
    return H.canonical_columns(r, mapping).select("seq", "survey_no", "subdivision_no", "owner_ref", "area", "full_survey")


def survey_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir, "drone").join(derived(spark, sf_dir, "parcels").select(F.col("parcel_id").alias("parcel_key"), "full_survey").hint("merge"), "parcel_key")
    return d.select("feature_id", X.normalized_survey(F.col("survey_candidate")).alias("normal"), X.survey_similarity(F.col("full_survey"), F.col("survey_candidate")).alias("similarity"))


def register_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived(spark, sf_dir, "register_text").select("doc_id", X.revenue_fields(F.col("text")).alias("f"))
    # An outer explode, as the filter that Spark puts below an inner one would search the text again.
    return t.select("doc_id", F.explode_outer("f").alias("field", "v")).where("field is not null").select("doc_id", "field", "v.value", "v.confidence")


def register_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = register_fields(spark, sf_dir).select("doc_id", "field", "value")
    corrections = fields.where("field = 'area_m2' and doc_id % 8 = 0").select("doc_id", "field", F.lit("1.0").alias("value"))
    return H.corrected_fields(fields, corrections)


_FIELDS = """rf AS (
  SELECT doc_id, 'survey_number' AS field, regexp_extract(text, 'Survey No: ([0-9]+/[0-9]+)', 1) AS value, 0.96::DOUBLE AS confidence FROM register_text UNION ALL
  SELECT doc_id, 'subdivision', regexp_extract(text, 'Survey No: [0-9]+/([0-9]+)', 1), 0.9::DOUBLE FROM register_text UNION ALL
  SELECT doc_id, 'owner_name', regexp_extract(text, 'Owner: ([A-Za-z ]+),', 1), 0.93::DOUBLE FROM register_text UNION ALL
  SELECT doc_id, 'area_m2', regexp_extract(text, 'Area: ([0-9.]+) sqm', 1), 0.95::DOUBLE FROM register_text UNION ALL
  SELECT doc_id, 'land_use', 'Residential', 0.91::DOUBLE FROM register_text WHERE doc_id % 3 = 0 UNION ALL
  SELECT doc_id, 'village', 'Kovil Patti', 0.95::DOUBLE FROM register_text WHERE doc_id % 5 = 0 UNION ALL
  SELECT doc_id, 'taluk', 'North', 0.94::DOUBLE FROM register_text WHERE doc_id % 5 = 0 UNION ALL
  SELECT doc_id, 'district', 'East', 0.97::DOUBLE FROM register_text WHERE doc_id % 5 = 0 UNION ALL
  SELECT doc_id, 'patta_number', doc_id::VARCHAR, 0.92::DOUBLE FROM register_text UNION ALL
  SELECT doc_id, 'status', regexp_extract(text, 'Status: ([A-Za-z]+)', 1), 0.95::DOUBLE FROM register_text)"""


def _utilities_sql(within: float, measure: str) -> str:
    """Counts by type within the distance; the nearest of all assets, 999 at most."""
    five = ", ".join(f"coalesce(sum(n) FILTER (utility_type = '{k}'), 0)::BIGINT AS n_{k.lower()}" for k in L.UTILITIES)
    return check(lines_sql(1e9, "utilities", "") + f""",
uc AS (SELECT parcel_id, utility_type, count(*) AS n, min(distance) AS least FROM ln WHERE distance <= {within} GROUP BY ALL),
us AS (SELECT parcel_id, coalesce(string_agg(utility_type, ',' ORDER BY utility_type) FILTER (least = 0), '') AS meets, coalesce(string_agg(utility_type, ',' ORDER BY utility_type), '') AS near, coalesce(string_agg(utility_type || ':' || n, ',' ORDER BY utility_type), '') AS counts, {five} FROM uc GROUP BY parcel_id),
un AS (SELECT parcel_id, min({measure}) AS least FROM ln GROUP BY parcel_id)""", f"""SELECT p.parcel_id, coalesce(meets, '') AS meets, coalesce(near, '') AS near, coalesce(counts, '') AS counts, {", ".join(f"coalesce(n_{k.lower()}, 0) AS n_{k.lower()}" for k in L.UTILITIES)},
  {" + ".join(f"coalesce(n_{k.lower()}, 0)" for k in L.UTILITIES)} AS utilities, {rnd("least(coalesce(un.least, 999), 999)", 1)} AS nearest_m FROM parcels p LEFT JOIN us USING (parcel_id) LEFT JOIN un USING (parcel_id)""", "parcels", "utilities")


_SHARED = rnd("inter", 2)
QUERIES = {
    "parcel_overlaps": (parcel_overlaps, check(OVERLAPS, f"SELECT a, b, {rnd('inter', 3)} AS overlap FROM ro", "drone")),
    "shared_boundaries": (shared_boundaries, check(OVERLAPS, f"SELECT a, b, w AS strategy, {_SHARED} AS overlap, {rnd('area_a', 2)} AS a_before, {rnd('area_b', 2)} AS b_before, {rnd('area_a - CASE WHEN w = $$PRIORITIZE_A$$ THEN 0 ELSE inter END', 2)} AS a_after, {rnd('area_b - CASE WHEN w = $$PRIORITIZE_A$$ THEN inter ELSE 0 END', 2)} AS b_after, CASE a % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'PENDING' END AS decision FROM ro CROSS JOIN (SELECT unnest(['PRIORITIZE_A', 'PRIORITIZE_B']) AS w)", "drone")),
    "bisected_boundaries": (bisected_boundaries, _bisect_sql()),
    "validation_issues": (validation_issues, check(OVERLAPS, "SELECT * FROM (SELECT 'legacy' AS source, 'Missing Geometry' AS issue, 'High' AS severity, false AS auto_fixed, count(*) AS n FROM parcels WHERE parcel_id % 47 = 7 AND parcel_id % 41 <> 5 AND parcel_id % 43 <> 6 UNION ALL SELECT 'legacy', 'Self-Intersection', 'Medium', true, count(*) FROM parcels WHERE parcel_id % 41 = 5 UNION ALL SELECT 'legacy', 'Overlap', 'High', false, count(*) FROM ro UNION ALL SELECT 'gnss', 'GNSS Out Of Range', 'Medium', false, count(*) FROM gnss WHERE abs(y / 20) > 90 OR abs(x / 20) > 180 UNION ALL SELECT 'legacy', 'Sliver', 'Low', false, count(*) FROM parcels WHERE parcel_id % 43 = 6 AND parcel_id % 41 <> 5) WHERE n > 0", "parcels", "drone", "gnss")),
    "repaired_rings": (repaired_rings, check("""t AS (SELECT *, ((x2 - x1) * (y4 - y2) - (y2 - y1) * (x4 - x2)) / ((x3 - x1) * (y4 - y2) - (y3 - y1) * (x4 - x2)) AS t FROM parcels WHERE parcel_id % 41 = 5),
x AS (SELECT *, x1 + t * (x3 - x1) AS px, y1 + t * (y3 - y1) AS py FROM t)""", f"SELECT parcel_id, 'REPAIRED' AS outcome, {rnd('greatest(abs((x3 - px) * (y2 - py) - (y3 - py) * (x2 - px)), abs((x4 - px) * (y1 - py) - (y4 - py) * (x1 - px))) / 2', 3)} AS area FROM x", "parcels")),
    "duplicate_geometries": (duplicate_geometries, check("", "SELECT parcel_key AS first_id, 2::BIGINT AS n FROM drone WHERE parcel_key % 10 = 0", "drone")),
    "source_counts": (source_counts, check("", " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n FROM {t}" for t in ("parcels", "drone", "gnss", "revenue")), "parcels", "drone", "gnss", "revenue")),
    "building_reference": (building_reference, check(BUILDINGS, f"SELECT b.building_id, CASE WHEN iou >= 50 THEN 'MATCHED' WHEN iou >= 20 THEN 'PARTIAL' ELSE 'UNMATCHED' END AS status, {rnd('coalesce(iou, 0)', 2)} AS iou, ref_id FROM buildings b LEFT JOIN (SELECT * FROM bb WHERE n = 1) x ON x.building_id = b.building_id", "buildings", "reference_buildings")),
    "parcel_layers": (parcel_layers, check(lines_sql(1e9) + f""",
be AS (SELECT id, i, ax AS x1, ay AS y1, bx AS x2, by_ AS y2 FROM ({edge_rows("buildings", "building_id")})), lb AS (SELECT parcel_id, building_id FROM parcels p JOIN buildings d ON {meets("p", "d")}),
bh AS (SELECT parcel_id, building_id FROM lb JOIN pe e ON e.id = lb.parcel_id JOIN be l ON l.id = lb.building_id GROUP BY ALL
  HAVING bool_or({_CROSS}) OR sum(CASE WHEN l.i = 1 AND (e.ay > l.y1) <> (e.by_ > l.y1) AND l.x1 < e.ax + (l.y1 - e.ay) * (e.bx - e.ax) / nullif(e.by_ - e.ay, 0) THEN 1 ELSE 0 END) % 2 = 1)""",
        f"SELECT p.parcel_id, coalesce(b.n, 0)::BIGINT AS buildings, coalesce(road_m, 0) AS road_m, coalesce(water, false) AS water, coalesce(power, false) AS power FROM parcels p LEFT JOIN (SELECT parcel_id, count(*) AS n FROM bh GROUP BY parcel_id) b ON b.parcel_id = p.parcel_id LEFT JOIN (SELECT parcel_id, {rnd('min(CASE WHEN layer = $$road$$ THEN distance END)', 2)} AS road_m, bool_or(layer = 'water' AND distance = 0) AS water, bool_or(layer = 'power' AND distance = 0) AS power FROM ln GROUP BY parcel_id) x ON x.parcel_id = p.parcel_id", "parcels", "layers", "buildings")),
    "parcel_utilities": (parcel_utilities, _utilities_sql(35, "from_middle")),
    "parcel_utilities_edge": (parcel_utilities_edge, _utilities_sql(15, "distance")),
    "parcel_utilities_15m": (parcel_utilities_15m, check(lines_sql(15.0), f"SELECT parcel_id, feature_id, utility_type, {rnd('distance', 2)} AS distance FROM ln WHERE distance <= 15", "parcels", "layers")),
    "building_audit": (building_audit, check(AUDIT, "SELECT * FROM au", "parcels", "buildings")),
    "building_audit_summary": (building_audit_summary, check(AUDIT, "SELECT count(*) AS validated, sum(in_extent::INT)::BIGINT AS in_extent, sum(conflict::INT)::BIGINT AS conflicts, sum((NOT conflict)::INT)::BIGINT AS contained FROM au", "parcels", "buildings")),
    "plausible_buildings": (plausible_buildings, check(f"de AS MATERIALIZED ({edge_rows('detections', 'building_id')}), dp AS (SELECT id, abs(sum(ax * by_ - bx * ay)) / 2 AS area, sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) AS around, max(ax) - min(ax) AS w, max(ay) - min(ay) AS h FROM de GROUP BY id)",
        "SELECT id AS building_id FROM dp WHERE area BETWEEN 15 AND 1800 AND greatest(w, h) <= 70 AND greatest(w, h) <= 4.5 * least(w, h) AND 4 * pi() * area / (around * around) >= 0.12", "detections")),
    "lod1_blocks": (lod1_blocks, check("", "SELECT building_id, 430.0::DOUBLE + h AS roof_elevation, (x2 - x1) * (y4 - y1) * h AS volume, 430.0::DOUBLE + h AS roof_z, h AS stratum_height FROM (SELECT *, (building_id % 9 + 3)::DOUBLE AS h FROM buildings)", "buildings")),
    "sync_changes": (sync_changes, check(SYNC, "SELECT * FROM sy", "snapshot_old", "snapshot_new")),
    "sync_summary": (sync_summary, check(SYNC, "SELECT change, count(*) AS features, count(DISTINCT parcel_id) AS parcels FROM sy GROUP BY change", "snapshot_old", "snapshot_new")),
    "sync_marked": (sync_marked, check(SYNC, "SELECT parcel_id, CASE WHEN parcel_id IN (SELECT parcel_id FROM sy WHERE change = 'GEOMETRY_CHANGED') THEN 'REVIEW_REQUIRED' ELSE 'Matched' END AS status FROM parcels", "snapshot_old", "snapshot_new", "parcels")),
    "sync_transitions": (sync_transitions, "WITH r AS (SELECT o_orderkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'SYNC_REQUIRED' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'APPROVED' END AS status, o_orderkey % 4 AS n_changes, o_orderkey % 5 = 0 AS approved, o_orderkey % 7 AS version FROM orders) SELECT *, CASE WHEN status = 'SYNC_REQUIRED' AND n_changes > 0 THEN 'REVIEW_REQUIRED' WHEN status = 'REVIEW_REQUIRED' AND approved THEN 'APPROVED' ELSE status END AS next_status, version + CASE WHEN status = 'REVIEW_REQUIRED' AND approved THEN 1 ELSE 0 END AS next_version FROM r"),
    "sync_approvals": (sync_approvals, "SELECT o_orderkey AS run_id, o_orderkey % 7 + 1 AS version, 'Harmonized version ' || (o_orderkey % 7 + 1) || ' after run ' || o_orderkey AS description, 'APPROVED' AS decision, 'detect changes > review ' || (o_orderkey % 4) || ' changes > approve synchronization' AS steps FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 5 = 0"),
    "sync_by_key": (sync_by_key, check(SYNC, "SELECT CASE WHEN feature_id % 3 = 2 THEN 'P' WHEN feature_id % 4 <> 0 THEN 'S' ELSE 'I' END || feature_id AS feature_id, change FROM sy", "snapshot_old", "snapshot_new")),
    "dataset_versions": (dataset_versions, "SELECT o_custkey AS dataset, o_orderkey AS id, row_number() OVER w AS version, lead(o_orderdate) OVER w IS NULL AS active FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "result_upsert": (result_upsert, "WITH e AS (SELECT user_id AS id, event_id AS seq, value FROM events), c AS (SELECT * FROM e WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1), b AS (SELECT * FROM e WHERE seq % 2 = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) SELECT * FROM c WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT * FROM b"),
    "raster_stats": (raster_stats, check("", f"SELECT raster_id, count(*) AS n, min(elev) AS low, max(elev) AS high, {rnd('avg(elev)', 4)} AS mean FROM dem WHERE elev <> -9999 GROUP BY raster_id", "dem")),
    "raster_window": (raster_window, check("", "SELECT raster_id, count(*) AS n FROM dem WHERE x BETWEEN 400 AND 1600 AND y BETWEEN 40 AND 160 GROUP BY raster_id", "dem")),
    "raster_zonal": (raster_zonal, check("", f"SELECT parcel_id, count(*) AS n, min(elev) AS low, max(elev) AS high, {rnd('avg(elev)', 4)} AS mean, max(elev) - min(elev) AS relief, {rnd('degrees(atan2(max(elev) - min(elev), 35.0))', 4)} AS slope FROM parcels p JOIN dem m ON m.x BETWEEN least(x1, x2, x3, x4) AND greatest(x1, x2, x3, x4) AND m.y BETWEEN least(y1, y2, y3, y4) AND greatest(y1, y2, y3, y4) WHERE elev <> -9999 GROUP BY parcel_id", "parcels", "dem")),
    "raster_zonal_masked": (raster_zonal_masked, check(f"pe AS MATERIALIZED ({edge_rows('parcels', 'parcel_id')}), mp AS (SELECT parcel_id, m.rid, any_value(m.elev) AS elev FROM parcels p JOIN (SELECT *, row_number() OVER () AS rid FROM dem) m ON m.elev <> -9999 AND m.x BETWEEN least(x1, x2, x3, x4) AND greatest(x1, x2, x3, x4) AND m.y BETWEEN least(y1, y2, y3, y4) AND greatest(y1, y2, y3, y4) JOIN pe e ON e.id = p.parcel_id GROUP BY ALL HAVING sum(CASE WHEN (e.ay > m.y) <> (e.by_ > m.y) AND m.x < e.ax + (m.y - e.ay) * (e.bx - e.ax) / nullif(e.by_ - e.ay, 0) THEN 1 ELSE 0 END) % 2 = 1)".replace("GROUP BY ALL", "GROUP BY parcel_id, m.rid, m.x, m.y"), f"SELECT parcel_id, count(*) AS n, min(elev) AS low, max(elev) AS high, {rnd('avg(elev)', 4)} AS mean, max(elev) - min(elev) AS relief, {rnd('degrees(atan2(max(elev) - min(elev), 35.0))', 4)} AS slope FROM mp GROUP BY parcel_id", "parcels", "dem")),
    "raster_registration": (raster_registration, f"WITH {HEADERS} SELECT raster_id, {rnd('res_x * CASE WHEN unit = $$degree$$ THEN 11113900.0 ELSE 100.0 END', 1)} AS gsd_cm, CASE bands WHEN 4 THEN 'Red,Green,Blue,Near-Infrared (NIR)' WHEN 1 THEN 'Panchromatic/Grayscale' ELSE 'Red,Green,Blue' END AS band_names FROM h"),
    "raster_tiles": (raster_tiles, f"WITH {HEADERS}, x AS (SELECT *, unnest(range(0, greatest(width - 64, 1), 576)) AS x0 FROM h), y AS (SELECT *, unnest(range(0, greatest(height - 64, 1), 576)) AS y0 FROM x) SELECT raster_id, x0, y0, least(640, width - x0) AS w, least(640, height - y0) AS h FROM y"),
    "raster_comparable": (raster_comparable, f"WITH {HEADERS} SELECT p.raster_id AS a, q.raster_id AS b, p.crs FROM h p JOIN h q ON p.raster_id < q.raster_id AND p.crs = q.crs AND p.minx <= q.maxx AND q.minx <= p.maxx AND p.miny <= q.maxy AND q.miny <= p.maxy"),
    "raster_difference": (raster_difference, check(DIFF, "SELECT * FROM df", "pixels_1", "pixels_2")),
    "raster_mask": (raster_mask, check(f"{DIFF},\n{MORPH}", "SELECT * FROM m4", "pixels_1", "pixels_2")),
    "change_regions": (change_regions, check(f"{DIFF},\n{MORPH},\n{REGIONS}", f"SELECT {NAMED}, count(*) AS pixels FROM rr GROUP BY region", "pixels_1", "pixels_2").replace("WITH ", "WITH RECURSIVE ", 1)),
    "change_region_report": (change_region_report, check(f"{DIFF},\n{MORPH},\n{REGIONS},\nq AS (SELECT region, count(*) AS pixels, count(*) * 0.25::DOUBLE AS area, min(px_row) AS row_min, max(px_row) AS row_max, min(px_col) AS col_min, max(px_col) AS col_max, {rnd('avg(g1) + 1e-9', 3)} AS mean_1, {rnd('avg(g2) + 1e-9', 3)} AS mean_2 FROM rr JOIN df USING (px_row, px_col) GROUP BY region HAVING count(*) >= 3)",
        f"SELECT q.* EXCLUDE (region), {NAMED}, CASE WHEN mean_2 - mean_1 > 35 THEN 'BUILDING_ADDED' WHEN mean_2 - mean_1 < -35 THEN 'BUILDING_REMOVED' WHEN abs(mean_2 - mean_1) > 15 AND pixels < 1500 THEN 'BUILDING_EXPANSION' ELSE 'SIGNIFICANT_LAND_COVER_CHANGE' END AS kind, CASE WHEN mean_2 - mean_1 > 35 THEN 93.5 WHEN mean_2 - mean_1 < -35 THEN 91.0 WHEN abs(mean_2 - mean_1) > 15 AND pixels < 1500 THEN 89.5 ELSE 88.0 END::DOUBLE AS confidence FROM q", "pixels_1", "pixels_2").replace("WITH ", "WITH RECURSIVE ", 1)),
    "affine_residuals": (affine_residuals, check(_AFFINE, f"SELECT sheet_id, any_value(n) AS n, {rnd('sqrt(avg(sq))', 4)} AS rmse, {rnd('avg(sqrt(sq))', 4)} AS mean_residual, {rnd('sqrt(max(sq))', 4)} AS max_residual, sqrt(avg(sq)) <= 2.5 AS accepted FROM r GROUP BY sheet_id", "control_points")),
    "affine_to_map": (affine_to_map, check(_AFFINE, f"SELECT p.point_id, {rnd('mx', 3)} AS x, {rnd('my', 3)} AS y FROM control_points p LEFT JOIN r USING (point_id)", "control_points")),
    "utm_round_trip": (utm_round_trip, _utm_sql()),
    "crs_check": (crs_check, "WITH p AS (SELECT c_nationkey AS dataset, CASE WHEN c_custkey % 50 = 0 THEN 200.0 ELSE 72 + c_nationkey / 4 + c_custkey % 8 END::DOUBLE AS lon, (c_custkey % 60 - 20.0)::DOUBLE AS lat FROM customer), z AS (SELECT *, lon <= 180 AS ok, (floor((lon + 180) / 6) + 1)::INT AS zone FROM p) SELECT dataset, coalesce(string_agg(DISTINCT CASE WHEN ok THEN zone END::VARCHAR, ',' ORDER BY CASE WHEN ok THEN zone END::VARCHAR), '') AS zones, min(CASE WHEN ok THEN CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone END)::INT AS epsg, sum((NOT ok)::INT)::BIGINT AS outside, concat_ws('; ', CASE WHEN count(DISTINCT CASE WHEN ok THEN zone END) > 1 THEN 'spans several zones' END, CASE WHEN sum((NOT ok)::INT) > 0 THEN 'positions out of range' END) AS warnings FROM z GROUP BY dataset"),
    "header_mapping": (header_mapping, _header_sql()),
    "harmonized_records": (harmonized_records, HARMONIZED),
    "canonical_records": (canonical_records, check("", "SELECT seq, survey_no, subdivision_no, owner_ref, area, CASE WHEN subdivision_no <> '' THEN survey_no || '/' || subdivision_no ELSE survey_no END AS full_survey FROM revenue", "revenue")),
    "survey_similarity": (survey_similarity, check("", "SELECT feature_id, regexp_replace(survey_candidate, '(^|/)0+([^/])', '\\1\\2', 'g') AS normal, CASE WHEN parcel_key % 13 = 1 THEN 20.0 WHEN parcel_key % 13 = 2 THEN 80.0 ELSE 100.0 END::DOUBLE AS similarity FROM drone", "drone")),
    "register_fields": (register_fields, check(_FIELDS, "SELECT * FROM rf", "register_text")),
    "register_corrections": (register_corrections, check(_FIELDS, "SELECT doc_id, field, CASE WHEN field = 'area_m2' AND doc_id % 8 = 0 THEN '1.0' ELSE value END AS value, field = 'area_m2' AND doc_id % 8 = 0 AS verified FROM rf", "register_text")),
}
