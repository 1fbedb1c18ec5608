"""Registered queries over typed shapes, whole files and whole records, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import shapes as S
from ..functions.numbers import rounded
from ..operators import layers as L
from ..operators import matching as M
from ..operators import reconcile as R
from ..operators import sync as Y
from ..operators import topology as T
from ..operators.four_files import reconcile_files
from ..operators.spatial_join import candidates, self_overlaps
from ..scratch import shared_path
from ..sources import readers as I
from ..sources import writers as O
from .fixtures import derived
from .layer_queries import _CROSS, _seg
from .match_queries import GNSS, TO_ASSESSED, centroid_cte, check, edge_rows, inter_cte, rnd

#: Where the parcels lie on the map of the four-file run: metres in UTM zone 43, and the grid of projected coordinates.
EAST, NORTH, ZONE, GRID = 700_000.0, 1_200_000.0, 43, 1 / 1024


def _square(x: Column, y: Column, w: Column) -> Column:
    return F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + w), G.point(x, y + w))


def _lakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares with square holes, read from files."""
    t = derived(spark, sf_dir, "lakes")
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    shape = F.when(x.isNotNull(), S.of_rings(F.array(_square(x, y, w), _square(x + w / 4, y + w / 4, w / 2))))
    rows = t.select("layer", "feature_id", shape.alias("shape"))
    rows = rows.select("layer", "feature_id", O.shape_feature(F.col("shape"), F.col("feature_id"), [F.col("layer")]).alias("value"))
    root, paths = shared_path(spark, "lakes"), {}
    for name in ("building", "water", "power", "road"):
        paths[name] = f"{root}/{name}"
        O.export_features(rows.where(F.col("layer") == name), paths[name], "feature_id")
    return I.layers(spark, paths, lines=True)


def parcel_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings with courtyards, lakes with islands, and roads as areas, from files."""
    lakes = _lakes(spark, sf_dir)
    buildings = lakes.where("layer = 'building'").select(F.col("feature_id").alias("building_id"), "shape")
    return L.parcel_layers(derived(spark, sf_dir, "parcels"), buildings, lakes.select("layer", "shape"))


def _ring_edges(name: str, x: str, y: str, w: str, first: int) -> str:
    at = [(x, y), (f"{x} + {w}", y), (f"{x} + {w}", f"{y} + {w}"), (x, f"{y} + {w}")]
    return " UNION ALL ".join(f"SELECT feature_id AS id, {first + i} AS i, {a[0]} AS x1, {a[1]} AS y1, {b[0]} AS x2, {b[1]} AS y2 FROM {name}" for i, (a, b) in enumerate(zip(at, at[1:] + at[:1], strict=True)))


_BY_EDGE = lambda p, x, y, u, v: _seg("z.p", "z.").replace("z.px", x).replace("z.py", y).replace("z.ax", f"{p}.{u[0]}").replace("z.ay", f"{p}.{u[1]}").replace("z.bx", f"{p}.{v[0]}").replace("z.by_", f"{p}.{v[1]}")
_PASSED = lambda px, py, ax, ay, bx, by: f"(({ay} > {py}) <> ({by} > {py}) AND {px} < {ax} + ({py} - {ay}) * ({bx} - {ax}) / nullif({by} - {ay}, 0))::INT"
PARCEL_SHAPES = check(f"""pe AS MATERIALIZED ({edge_rows("parcels", "parcel_id")}),
le AS MATERIALIZED ({_ring_edges("lakes", "x", "y", "w", 1)} UNION ALL {_ring_edges("lakes", "x + w / 4", "y + w / 4", "w / 2", 5)}),
ls AS MATERIALIZED (
  SELECT e.id AS parcel_id, l.id AS feature_id,
         bool_or({_CROSS}) OR sum(CASE WHEN e.i = 1 THEN {_PASSED("e.ax", "e.ay", "l.x1", "l.y1", "l.x2", "l.y2")} END) % 2 = 1 OR sum(CASE WHEN l.i = 1 THEN {_PASSED("l.x1", "l.y1", "e.ax", "e.ay", "e.bx", "e.by_")} END) % 2 = 1 OR sum(CASE WHEN l.i = 5 THEN {_PASSED("l.x1", "l.y1", "e.ax", "e.ay", "e.bx", "e.by_")} END) % 2 = 1 AS hit,
         least(min({_BY_EDGE("l", "e.ax", "e.ay", ("x1", "y1"), ("x2", "y2"))}), min({_BY_EDGE("e", "l.x1", "l.y1", ("ax", "ay"), ("bx", "by_"))})) AS gap
  FROM pe e JOIN le l ON l.x1 IS NOT NULL GROUP BY ALL)""", f"""SELECT parcel_id, count(*) FILTER (layer = 'building' AND hit) AS buildings, {rnd("coalesce(min(CASE WHEN layer = 'road' THEN CASE WHEN hit THEN 0 ELSE gap END END), 0)", 2)} AS road_m,
  bool_or(layer = 'water' AND hit) AS water, bool_or(layer = 'power' AND hit) AS power FROM ls JOIN lakes USING (feature_id) GROUP BY parcel_id""", "parcels", "lakes")


def _holed(df: DataFrame, every: int) -> DataFrame:
    """Polygons with a courtyard, but for each ``every``-th, and a small second part 60 m above."""
    x1, y1 = F.col("x1"), F.col("y1")
    rings = F.array("ring", _square(x1 + 12, y1 + 12, F.lit(8.0)))
    two = _square(x1 + 4, y1 + 60, F.lit(4.0))
    whole = S.of_rings(F.when(F.col("parcel_key") % every == 0, F.array("ring")).otherwise(rings))
    both = F.struct(F.lit("polygon").alias("kind"), F.concat(whole["parts"], F.array(two)).alias("parts"))
    return df.withColumn("shape", F.when(F.col("parcel_key") % 3 == 1, both).otherwise(whole))


def _holed_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _holed(derived(spark, sf_dir, "parcels").withColumn("parcel_key", F.col("parcel_id")), 4), _holed(derived(spark, sf_dir, "drone"), 5)


def courtyard_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = _holed_sides(spark, sf_dir)
    names = ["inter", "union_area", "iou", "coverage_source", "coverage_candidate"]
    return M.overlaps(M.spread(candidates(p, d))).select("parcel_id", "feature_id", *[rounded(F.col(c), 4).alias(c) for c in names])


def courtyard_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = _holed_sides(spark, sf_dir)
    found = M.overlap_evidence(p, d, derived(spark, sf_dir, "gnss"))
    return found.select("parcel_id", "feature_id", rounded(F.col("iou"), 4).alias("iou"), "area_pct", "centroid_dist", "gnss_pct")


def courtyard_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps among the candidates' shapes."""
    d = _holed_sides(spark, sf_dir)[1]
    return self_overlaps(d.select(F.col("parcel_key").alias("parcel_id"), "ring", "shape")).select("a", "b", rounded(F.col("overlap"), 3).alias("overlap"))


def _holed_edges(table: str, key: str, parcel_key: str, every: int) -> str:
    """Edges of the outer ring, the courtyard (the other way round) and the second part."""
    hole = [("x1 + 12", "y1 + 12"), ("x1 + 12", "y1 + 20"), ("x1 + 20", "y1 + 20"), ("x1 + 20", "y1 + 12")]
    part = [("x1 + 4", "y1 + 60"), ("x1 + 8", "y1 + 60"), ("x1 + 8", "y1 + 64"), ("x1 + 4", "y1 + 64")]
    out = [edge_rows(table, key)]
    for ring, first, on in ((hole, 5, f"{parcel_key} % {every} <> 0"), (part, 9, f"{parcel_key} % 3 = 1")):
        for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True)):
            out.append(f"SELECT {key} AS id, {first + i} AS i, {a[0]} AS ax, {a[1]} AS ay, {b[0]} AS bx, {b[1]} AS by_ FROM {table} WHERE {on}")
    return " UNION ALL ".join(out)


def _box(p: str, key: str) -> dict[str, str]:
    top = f"CASE WHEN {p}.{key} % 3 = 1 THEN {p}.y1 + 64 ELSE {p}.y1 END"
    xs, ys = ", ".join(f"{p}.x{i}" for i in range(1, 5)), ", ".join(f"{p}.y{i}" for i in range(1, 5))
    return {"x0": f"least({xs})", "x1": f"greatest({xs})", "y0": f"least({ys})", "y1": f"greatest({ys}, {top})"}


def _near(p: dict, q: dict, by: float) -> str:
    return f"{p['x0']} - {by} <= {q['x1']} AND {q['x0']} <= {p['x1']} + {by} AND {p['y0']} - {by} <= {q['y1']} AND {q['y0']} <= {p['y1']} + {by}"


HOLED = f"""pe AS MATERIALIZED ({_holed_edges("parcels", "parcel_id", "parcel_id", 4)}), de AS MATERIALIZED ({_holed_edges("drone", "feature_id", "parcel_key", 5)}),
pa AS (SELECT id, sum(ax * by_ - bx * ay) / 2 AS area FROM pe GROUP BY id), da AS (SELECT id, sum(ax * by_ - bx * ay) / 2 AS area FROM de GROUP BY id),
cand AS MATERIALIZED (SELECT parcel_id, feature_id, pa.area AS pa, da.area AS qa FROM parcels p JOIN drone d ON {_near(_box("p", "parcel_id"), _box("d", "parcel_key"), 35.0)} JOIN pa ON pa.id = parcel_id JOIN da ON da.id = feature_id),
{inter_cte("ov", "cand", "pe", "de", "parcel_id", "feature_id")},
ovs AS MATERIALIZED (SELECT cand.*, inter, pa + qa - inter AS un, inter / (pa + qa - inter) * 100.0 AS iou FROM cand JOIN ov USING (parcel_id, feature_id))"""


def _degrees(df: DataFrame, *names: str) -> list[Column]:
    """x and y of the derived tables as longitude and latitude."""
    at = G.from_utm(F.col(names[0]) + EAST, F.col(names[1]) + NORTH, F.lit(ZONE))
    return [at["x"], at["y"]]


def four_file_run(spark: SparkSession, sf_dir: str):
    """The derived tables written as files in degrees, and the run over them."""
    root = shared_path(spark, "four-files")
    lift = lambda p: G.from_utm(p["x"] + EAST, p["y"] + NORTH, F.lit(ZONE))
    p = derived(spark, sf_dir, "parcels").withColumn("ring", F.transform("ring", lift))
    O.export_geojson(p, f"{root}/legacy", ["parcel_id", "survey_no", "subdivision_no", "full_survey", "area", "land_use"])
    d = derived(spark, sf_dir, "drone").withColumns({"ring": F.transform("ring", lift), "parcel_id": F.col("feature_id")})
    O.export_geojson(d, f"{root}/drone", ["feature_id", "survey_candidate", "feature_type", "area"])
    g = derived(spark, sf_dir, "gnss")
    lon, lat = _degrees(g, "x", "y")
    g.select("point_id", "survey_no", lat.alias("latitude"), lon.alias("longitude"), "accuracy_m", "seq").repartitionByRange(4, "seq").sortWithinPartitions("seq").drop("seq").write.option("header", True).csv(f"{root}/gnss")
    r = derived(spark, sf_dir, "revenue")
    r.where("area is not null").repartitionByRange(4, "seq").sortWithinPartitions("seq").drop("seq").write.option("header", True).csv(f"{root}/revenue")
    return reconcile_files(spark, f"{root}/legacy", f"{root}/drone", f"{root}/gnss", f"{root}/revenue", lines=True, precision=GRID)


def four_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary(four_file_run(spark, sf_dir).parcels)


def crossed_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that cross themselves twice, three times or touch a corner: their largest loop."""
    k = F.col("parcel_id")
    x, y = F.col("x1"), F.col("y1")
    dots = lambda *xy: F.array(*[G.point(x + a, y + b) for a, b in xy])
    ring = F.when(k % 3 == 0, dots((0, 0), (12, 12), (20, 4), (28, 12), (28, 0), (20, 8), (12, 0), (0, 12))).when(k % 3 == 1, dots((0, 0), (30, 0), (30, 10), (10, -10), (10, 10), (0, 10))).otherwise(dots((0, 0), (16, 0), (16, 16), (16, 0), (32, 0), (32, 8)))
    out = T.repaired(derived(spark, sf_dir, "parcels").select("parcel_id", ring.alias("ring")))
    return out.select("parcel_id", "outcome", rounded(G.area(F.col("repaired")), 3).alias("area"))


def _side(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """A snapshot with more properties, some null, in columns and in a map; with repeated ids and some without one."""
    s = derived(spark, sf_dir, "snapshot_old").select(F.col("feature_id").alias("k"), "parcel_id", "area", "owner", "geom_key")
    k = F.col("k")
    late = F.lit(new)
    use = F.when(k % 4 == 0, "Residential").when((k % 6 == 1) & late, "Commercial").when(k % 5 != 0, "Agricultural")
    note = F.when((k % 17 == 3) & late, F.concat(F.lit("n"), k.cast("string"))).when(k % 17 != 4, "plain")
    row = s.select(F.when(k % 23 != 0, k).alias("feature_id"), "parcel_id", "area", "owner", "geom_key", use.alias("land_use"), F.create_map(F.lit("note"), note, F.lit("ward"), (k % 9).cast("string")).alias("props"), F.lit(2).alias("seq"))
    again = row.where("feature_id % 10 = 0").withColumns({"seq": F.lit(1), "owner": F.lit("stale")})
    return row.unionByName(again)


def sync_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Y.changes(_side(spark, sf_dir, False), _side(spark, sf_dir, True), order="seq")
    return found.groupBy("feature_id", "parcel_id", "change", F.array_join("changed", ",").alias("changed")).agg(F.count("*").alias("n"))


_USE = lambda late: f"CASE WHEN k % 4 = 0 THEN 'Residential' {'WHEN k % 6 = 1 THEN $$Commercial$$' if late else ''} WHEN k % 5 <> 0 THEN 'Agricultural' END"
_NOTE = lambda late: f"CASE {'WHEN k % 17 = 3 THEN $$n$$ || k' if late else ''} WHEN k % 17 <> 4 THEN 'plain' END"
SYNC_RECORDS = check(f"""s AS (SELECT *, feature_id AS k FROM snapshot_old),
b AS (SELECT k, parcel_id, area, owner, geom_key, k % 9 AS ward, {_USE(False)} AS u0, {_USE(True)} AS u1, {_NOTE(False)} AS n0, {_NOTE(True)} AS n1 FROM s),
w AS (SELECT k, parcel_id, 'ATTRIBUTE_CHANGED' AS change, concat_ws(',', CASE WHEN u0 IS DISTINCT FROM u1 THEN 'land_use' END, CASE WHEN n0 IS DISTINCT FROM n1 THEN 'note' END) AS changed FROM b WHERE k % 23 <> 0),
o AS (SELECT DISTINCT parcel_id, area, owner, geom_key, ward, u0 AS u, n0 AS n FROM b WHERE k % 23 = 0), n AS (SELECT DISTINCT parcel_id, area, owner, geom_key, ward, u1 AS u, n1 AS n FROM b WHERE k % 23 = 0),
x AS (SELECT *, 'REMOVED' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'ADDED' FROM (SELECT * FROM n EXCEPT SELECT * FROM o))""", """SELECT k AS feature_id, parcel_id, change, changed, 1::BIGINT AS n FROM w WHERE changed <> ''
UNION ALL SELECT NULL, parcel_id, change, '', count(*) FROM x GROUP BY parcel_id, change""", "snapshot_old")

_SIX = {"inter": "inter", "union_area": "un", "iou": "iou", "coverage_source": "inter / pa * 100.0", "coverage_candidate": "inter / qa * 100.0"}
QUERIES = {
    "parcel_shapes": (parcel_shapes, PARCEL_SHAPES),
    "courtyard_overlap": (courtyard_overlap, check(HOLED, f"SELECT parcel_id, feature_id, {', '.join(f'{rnd(x, 4)} AS {n}' for n, x in _SIX.items())} FROM ovs", "parcels", "drone")),
    "courtyard_evidence": (courtyard_evidence, check(f"{HOLED}, {GNSS}, {centroid_cte('pcen', 'pe')}, {centroid_cte('dcen', 'de')}", f"SELECT o.parcel_id, o.feature_id, {rnd('iou', 4)} AS iou, {rnd('least(' + rnd('pa', 2) + ', ' + rnd('qa', 2) + ') / greatest(' + rnd('pa', 2) + ', ' + rnd('qa', 2) + ') * 100', 1)} AS area_pct, {rnd('sqrt((a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy))', 2)} AS centroid_dist, {rnd('gc.inside / gc.points * 100.0', 1)} AS gnss_pct FROM ovs o JOIN pcen a ON a.id = o.parcel_id JOIN dcen b ON b.id = o.feature_id LEFT JOIN gc ON gc.parcel_id = o.parcel_id AND gc.feature_id = o.feature_id", "parcels", "drone", "gnss")),
    "courtyard_neighbours": (courtyard_neighbours, check(f"de AS MATERIALIZED ({_holed_edges('drone', 'parcel_key', 'parcel_key', 5)}), np AS (SELECT p.parcel_key AS a, d.parcel_key AS b FROM drone p JOIN drone d ON p.parcel_key < d.parcel_key AND {_near(_box('p', 'parcel_key'), _box('d', 'parcel_key'), 0.0)}), {inter_cte('ni', 'np', 'de', 'de', 'a', 'b')}", f"SELECT a, b, {rnd('inter', 3)} AS overlap FROM ni WHERE inter > 2", "drone")),
    # The register's rows with an area, as the file has no others.
    "four_file_summary": (four_file_summary, check(TO_ASSESSED.replace("FROM revenue", "FROM (SELECT * FROM revenue WHERE area IS NOT NULL)"), "SELECT count(*) AS total, sum((status = 'Matched')::INT)::BIGINT AS matched, sum((status = 'Conflict')::INT)::BIGINT AS conflicts, sum((status = 'Review')::INT)::BIGINT AS review FROM a", "parcels", "drone", "gnss", "revenue")),
    "crossed_rings": (crossed_rings, check("", "SELECT parcel_id, CASE WHEN parcel_id % 3 = 2 THEN 'QUARANTINED' ELSE 'REPAIRED' END AS outcome, CASE parcel_id % 3 WHEN 0 THEN 72.0 WHEN 1 THEN 100.0 END::DOUBLE AS area FROM parcels", "parcels")),
    "sync_records": (sync_records, SYNC_RECORDS),
}
