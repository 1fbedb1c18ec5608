"""Typed shapes: holes, parts, containment, files, and searches that end."""

import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelfusion.functions import shapes as S
from parcelfusion.operators import layers as L
from parcelfusion.operators.matching import evidence
from parcelfusion.operators.spatial_join import box_join, corner_cells, nearest, self_overlaps, wide_cells
from parcelfusion.operators.topology import repaired
from parcelfusion.plans.fixtures import derived
from parcelfusion.sources import readers as I
from parcelfusion.sources import writers as O

from test_geometry import RING, box, pts

KIND = "kind string, parts array<" + RING + ">"


def square(x, y, w):
    return [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]


@pytest.fixture
def shapes(spark):
    """id and shape of GeoJSON geometries (type, coordinates)."""

    def make(*geometries):
        rows = [(i, t, None if c is None else json.dumps(c)) for i, (t, c) in enumerate(geometries)]
        return spark.createDataFrame(rows, "id int, t string, c string").select("id", S.of_geojson(F.col("t"), F.col("c")).alias("shape"), S.exterior_of_geojson(F.col("t"), F.col("c")).alias("ring"))

    return make


def test_holes_and_parts(shapes):
    hole, two = square(2, 2, 6), [[square(0, 0, 2)], [square(10, 0, 5), square(11, 1, 2)]]
    s = F.col("shape")
    df = shapes(("Polygon", [square(0, 0, 10), hole]), ("Polygon", [square(0, 0, 10)[::-1], hole[::-1]]), ("MultiPolygon", two), ("LineString", [[0, 0], [3, 4]]), ("MultiPoint", [[1, 2], [3, 4]]), ("Polygon", []), ("Polygon", [[[0, None], [1, 1], [2, 0]]]), ("GeometryCollection", None), (None, None), ("Point", [1, 2, 3]))
    got = df.select("id", S.area(s).alias("area"), S.perimeter(s).alias("p"), S.centroid(s).alias("c"), F.size("ring").alias("n"), F.get("ring", F.lit(0))["x"].alias("x"), s["kind"].alias("kind")).orderBy("id").collect()
    assert [r.area for r in got] == [64.0, 64.0, 4.0 + 21.0, 0.0, 0.0, None, None, None, None, 0.0]
    assert [r.p for r in got[:5]] == [64.0, 64.0, 8.0 + 28.0, 5.0, 0.0]
    assert [(r.c.x, r.c.y) for r in got[:2]] == [(5.0, 5.0)] * 2 and (got[3].c.x, got[3].c.y, got[4].c.x, got[4].c.y) == (1.5, 2.0, 2.0, 3.0)
    assert got[2].c.x == pytest.approx((4 * 1 + 25 * 12.5 - 4 * 12) / 25) and got[2].x == 10.0 and got[2].n == 4
    assert [r.kind for r in got] == ["polygon"] * 3 + ["line", "point", None, None, None, None, "point"]


def test_containment_and_distance(shapes):
    """A polygon inside another meets it; one inside a hole does not."""
    big, small, far, holed = ("Polygon", [square(0, 0, 100)]), ("Polygon", [square(20, 20, 5)]), ("Polygon", [square(130, 0, 5)]), ("Polygon", [square(0, 0, 100), square(10, 10, 50)])
    line, point, touching = ("LineString", [[30, 30], [40, 40]]), ("Point", [50, 5]), ("Polygon", [square(100, 100, 3)])
    a, b = shapes(big, small, far, holed, line, point, touching).select(F.col("id").alias("a"), F.col("shape").alias("s")), shapes(big, small, far, holed, line, point, touching).select(F.col("id").alias("b"), F.col("shape").alias("t"))
    got = {(r.a, r.b): (r.m, r.d, r.i) for r in a.join(b.hint("merge"), F.col("a") >= F.col("b") - 99).select("a", "b", S.meets(F.col("s"), F.col("t")).alias("m"), S.distance(F.col("s"), F.col("t")).alias("d"), S.intersection_area(F.col("s"), F.col("t")).alias("i")).collect()}
    want = {(0, 1): (True, 0.0, 25.0), (0, 2): (False, 30.0, 0.0), (1, 3): (False, 10.0, 0.0), (0, 3): (True, 0.0, 7500.0), (3, 4): (False, 20.0, 0.0), (0, 4): (True, 0.0, 0.0), (3, 5): (True, 0.0, 0.0), (0, 6): (True, 0.0, 0.0), (4, 5): (False, math.hypot(20, 25), 0.0), (3, 3): (True, 0.0, 7500.0)}
    for (i, j), (m, d, area) in want.items():
        for k in ((i, j), (j, i)):
            assert (got[k][0], pytest.approx(got[k][1]), pytest.approx(got[k][2])) == (m, d, area), k


def test_overlap_of_shapes_with_holes_against_cells(shapes):
    """Shapes of unit cells: the shared area is the number of cells that both hold."""
    rng, rows = random.Random(4), []
    for _ in range(40):
        x, y, w = rng.randrange(6), rng.randrange(6), rng.randrange(3, 8)
        hx, hy, hw = x + 1, y + 1, rng.randrange(1, w - 1)
        rows.append(("MultiPolygon", [[square(x, y, w), square(hx, hy, hw)], [square(20, y, 2)]]))
    cells = []
    for _, ((o, h), (q,)) in rows:
        held = {(i, j) for i in range(o[0][0], o[1][0]) for j in range(o[0][1], o[2][1])} - {(i, j) for i in range(h[0][0], h[1][0]) for j in range(h[0][1], h[2][1])}
        cells.append(held | {(i, j) for i in (20, 21) for j in range(q[0][1], q[0][1] + 2)})
    df = shapes(*rows)
    pairs = df.select(F.col("id").alias("a"), F.col("shape").alias("s")).join(df.select(F.col("id").alias("b"), F.col("shape").alias("t")).hint("merge"), F.col("a") <= F.col("b"))
    for r in pairs.select("a", "b", S.intersection_area(F.col("s"), F.col("t")).alias("i")).collect():
        assert r.i == pytest.approx(len(cells[r.a] & cells[r.b]), abs=1e-9)


def parcels_of(spark, *rows):
    return spark.createDataFrame(rows, f"parcel_id long, ring {RING}")


def test_parcel_inside_a_building_and_a_lake(spark):
    parcels = parcels_of(spark, (1, box(20, 20, 5, 5)), (2, None), (3, []))
    buildings = spark.createDataFrame([(1, box(0, 0, 100, 100)), (2, None)], f"building_id long, ring {RING}")
    lake = [("water", *_shape("polygon", [box(-10, -10, 200, 200)])), ("power", *_shape("line", [pts((0, 22), (100, 22))])), ("road", *_shape("line", [pts((0, 500), (9, 500))])), ("road", None, None)]
    layers = spark.createDataFrame(lake, f"layer string, {KIND}").select("layer", F.when(F.col("kind").isNotNull(), F.struct("kind", "parts")).alias("shape"))
    got = {r.parcel_id: tuple(r)[1:] for r in L.parcel_layers(parcels, buildings, layers).collect()}
    assert got == {1: (1, 475.13, True, True), 2: (0, 0.0, False, False), 3: (0, 0.0, False, False)}


def _shape(kind, parts):
    return kind, parts


def test_nearest_ends(spark):
    """Without a shape on either side, without any feature, and with one very far away."""
    far = spark.createDataFrame([_shape("point", [pts((5e6, 0))]), (None, None)], KIND).select(F.when(F.col("kind").isNotNull(), F.struct("kind", "parts")).alias("shape"))
    parcels = parcels_of(spark, (1, box(0, 0, 10, 10)), (2, None))
    assert [tuple(r) for r in L.nearest_features(parcels, far).collect()] == [(1, 5e6 - 10)]
    assert L.nearest_features(parcels, far.where("shape is null")).collect() == []
    assert L.nearest_features(parcels.where("parcel_id = 2"), far).collect() == []
    assert L.nearest_features(parcels, far, farthest=999.0).collect() == []


def test_utilities_of_every_type_and_distance(spark):
    parcels = parcels_of(spark, (1, box(0, 0, 20, 20)), (2, box(400, 0, 20, 20)), (3, box(9000, 0, 20, 20)), (4, None))
    rows = [("Gas", "line", [pts((-5, 10), (25, 10))]), ("Telecom", "point", [pts((30, 10))]), ("Telecom", "point", [pts((56, 10))]), ("Steam", "point", [pts((22, 10))]), ("Water", "polygon", [box(-50, -50, 200, 200)]), (None, "point", [pts((21, 21))])]
    assets = spark.createDataFrame(rows, f"utility_type string, {KIND}").select("utility_type", F.struct("kind", "parts").alias("shape"))
    got = {r.parcel_id: r for r in L.parcel_utilities(parcels, assets).collect()}
    a = got[1]
    assert (a.meets, a.near, a.counts) == ("Gas,Water", "Gas,Steam,Telecom,Water", {"Gas": 1, "Steam": 1, "Telecom": 1, "Water": 1})
    assert (a.n_gas, a.n_telecom, a.n_water, a.n_sewer, a.n_electricity, a.utilities, a.nearest_m) == (1, 1, 1, 0, 0, 3, 0.0)
    assert (got[2].utilities, got[2].near, got[2].counts, got[2].nearest_m) == (0, "", {}, pytest.approx(round(410 - 56, 1)))
    assert (got[3].nearest_m, got[4].nearest_m, got[4].meets) == (999.0, 999.0, "")
    edge = {r.parcel_id: r for r in L.parcel_utilities(parcels, assets, 15.0, by_centroid=False).collect()}
    assert (edge[1].near, edge[2].nearest_m) == ("Gas,Steam,Telecom,Water", 250.0)


def test_audit_rules(spark):
    """A building over no parcel is no conflict; extent by centroid or contact; touching parcels are encroached."""
    buildings = spark.createDataFrame([(1, box(900, 900, 10, 10)), (2, box(95, 10, 10, 10)), (3, box(100, 40, 10, 10)), (4, box(-30, 0, 10, 10)), (5, None)], f"building_id long, ring {RING}")
    parcels = spark.createDataFrame([(1, "10/1", box(0, 0, 100, 100)), (2, "11", box(100, 0, 50, 30))], f"parcel_id long, full_survey string, ring {RING}")
    got = {r.building_id: r for r in L.building_audit(buildings, parcels, (0.0, 0.0, 100.0, 100.0)).collect()}
    names = ("parcel_id", "inside_pct", "outside_pct", "encroached", "in_extent", "conflict")
    assert [tuple(got[i][n] for n in names) for i in range(1, 6)] == [(None, 100.0, 0.0, "", False, False), (1, 50.0, 50.0, "2", True, True), (None, 100.0, 0.0, "1", True, False), (None, 100.0, 0.0, "", False, False), (None, 100.0, 0.0, "", False, False)]
    assert got[2].explanation == "Building 2 situated in Parcel 1 (10/1). Area: 100.00 m2. Inside: 50.0%, Outside: 50.0%. Status: Boundary Conflict."
    assert "Parcel Unassigned (N/A)" in got[1].explanation and got[1].status == "Within Parcel"


def test_holes_in_matching(spark):
    """A courtyard counts in overlap, area and point containment of parcels and candidates."""
    holed = [box(0, 0, 40, 40), box(10, 10, 20, 20)[::-1]]
    rows = [(1, "1/1", "1", holed[0], "polygon", holed)]
    parcels = spark.createDataFrame(rows, f"parcel_id long, full_survey string, survey_no string, ring {RING}, {KIND}").withColumn("shape", F.struct("kind", "parts")).drop("kind", "parts")
    drone = parcels.select(F.lit("F1").alias("feature_id"), F.lit("1/1").alias("survey_candidate"), "ring", "shape")
    gnss = spark.createDataFrame([("1/1", 5.0, 5.0), ("1/1", 20.0, 20.0), ("1/1", 10.5, 20.0)], "survey_no string, x double, y double")
    (r,) = evidence(parcels, drone, gnss).collect()
    assert (r.iou, r.p_area, r.inter, r.points, r.inside) == (100.0, 1200.0, 1200.0, 3, 2)
    plain = drone.select("feature_id", "survey_candidate", "ring")
    (r,) = evidence(parcels, plain, gnss).collect()
    assert (r.q_area, r.inter, r.iou) == (1600.0, 1200.0, 75.0)
    twins = parcels.unionByName(parcels.withColumn("parcel_id", F.lit(2)).withColumn("shape", S.of_ring(F.transform(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((10, 10), (30, 10), (30, 30), (10, 30))]), lambda p: p))))
    assert self_overlaps(twins).collect() == []  # one fills the other's courtyard


def test_files_keep_holes_parts_and_types(spark, tmp_path, shapes):
    two = [[square(0, 0, 10), square(2, 2, 6)], [square(20, 0, 3)]]
    text = I.as_json_text([{"type": "Feature", "id": "a", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": two}}, {"type": "Feature", "id": "b", "properties": {"utility_type": "Gas"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}}, {"type": "Feature", "id": "c", "properties": {}, "geometry": None}])
    (tmp_path / "x.geojson").write_text(text)
    p = {r.parcel_id: r for r in I.legacy_parcels(spark, str(tmp_path)).collect()}
    assert p["P001"].area == 64.0 + 9.0 and len(p["P001"].shape.parts) == 3 and len(p["P001"].ring) == 4 and p["P003"].shape is None
    u = {r.utility_id: r for r in I.utilities(spark, str(tmp_path)).collect()}
    assert u["b"].shape.kind == "line" and u["b"].utility_type == "Gas" and u["c"].shape is None
    out = str(tmp_path / "out")
    I.layers(spark, {"l": str(tmp_path / "x.geojson")}).select(O.shape_feature(F.col("shape"), F.col("feature_id"), [F.col("layer")]).alias("value")).write.text(out)
    back = {r.feature_id: r for r in I.layers(spark, {"l": out}, lines=True).collect()}
    first = {r.feature_id: r for r in I.layers(spark, {"l": str(tmp_path / "x.geojson")}).collect()}
    assert {k: r.shape for k, r in back.items()} == {k: r.shape for k, r in first.items()}


def test_rows_per_box_are_few(spark):
    """One box over everything among small ones, and long roads: every box takes four rows at most, and each pair is met once."""
    rng = random.Random(9)
    boxes = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate((rng.randrange(5000), rng.randrange(5000), rng.choice([0, 5, 40, 3000]), rng.choice([0, 3, 40, 64])) for _ in range(300))]
    boxes.append((300, -1e5, -1e5, 1e5, 1e5))
    df = spark.createDataFrame(boxes, "i int, minx double, miny double, maxx double, maxy double").select("i", F.struct("minx", "miny", "maxx", "maxy").alias("box"))
    assert wide_cells(df, "box", 64.0).groupBy("i").count().agg(F.max("count")).first()[0] <= 4
    levels = [0, 3, 7, 13]
    assert corner_cells(df, "box", 64.0, levels, True).groupBy("i").count().agg(F.max("count")).first()[0] <= len(levels)
    pairs = sorted(map(tuple, box_join(df.select(F.col("i").alias("a"), F.col("box").alias("x")), df.select(F.col("i").alias("b"), F.col("box").alias("y")), "x", "y").select("a", "b").collect()))
    meet = lambda p, q: p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    assert pairs == sorted((p[0], q[0]) for p in boxes for q in boxes if meet(p, q))


def test_crossings_by_kernel_and_dealt_rows(spark):
    """Edges that meet, touch or run along each other, by part; null for null. Rows of one small file go to all cores before they are tested and cut."""
    bow, fine, touch = pts((0, 0), (10, 10), (10, 0), (0, 6)), box(0, 0, 5, 5), pts((0, 0), (16, 0), (16, 16), (16, 0), (32, 0), (32, 8))
    rows = [(1, [fine, bow]), (2, [fine, fine]), (3, [touch]), (4, None), (5, [bow[:3]]), (6, []), (7, [fine, None])]
    df = spark.createDataFrame(rows, f"id int, parts array<{RING}>")
    got = {r.id: r.c for r in df.select("id", S.crosses_itself(F.struct(F.lit("polygon").alias("kind"), "parts")).alias("c")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: None, 5: False, 6: False, 7: None}
    parcels = spark.createDataFrame([(i, bow if i % 2 else fine) for i in range(100)], f"parcel_id long, ring {RING}").coalesce(1)
    out = repaired(parcels)
    assert out.rdd.getNumPartitions() >= 8 and sorted(r.parcel_id for r in out.collect()) == list(range(1, 100, 2))
    assert all(len(r.repaired) == 3 and r.original_wkt.startswith("POLYGON ((0.0 0.0, 10.0 10.0") for r in out.collect())


def test_nearest_compares_with_few(spark):
    """Far from everything, among the features, and between copies: the distances of all pairs, from a few pairs a row."""
    rng, seen = random.Random(9), spark.sparkContext.accumulator(0)
    spots = [(rng.uniform(0, 400), rng.uniform(0, 80)) for _ in range(300)] * 3
    rows = [(i, rng.choice((0.0, 300.0, 5e4)) + rng.uniform(0, 100), rng.choice((0.0, 2e3, 8e4)) + rng.uniform(0, 100)) for i in range(300)] + [(1000 + i, 7e4, 10.0) for i in range(50)]
    box_of = "named_struct('minx', x, 'miny', y, 'maxx', x, 'maxy', y)"
    left = spark.createDataFrame(rows, "id int, x double, y double").selectExpr("id", f"{box_of} AS l_box")
    right = spark.createDataFrame(spots, "x double, y double").selectExpr(f"{box_of} AS r_box", "array(named_struct('x', x, 'y', y)) AS r_spots")

    @F.pandas_udf("double")
    def distance(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        seen.add(len(a))
        return ((a.minx - b.minx) ** 2 + (a.miny - b.miny) ** 2) ** 0.5

    want = {i: min(math.hypot(x - u, y - v) for u, v in spots) for i, x, y in rows}
    got = {r.id: r.distance for r in nearest(left, right, "id", distance("l_box", "r_box"), "l_box", "r_box", "r_spots").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(d, abs=1e-6) for i, d in want.items())
    assert 0 < seen.value < 40 * len(rows)
    near = {r.id: r.distance for r in nearest(left, right, "id", distance("l_box", "r_box"), "l_box", "r_box", "r_spots", farthest=1e3).collect()}
    assert near.keys() == {i for i, d in want.items() if d <= 1e3} and all(near[i] == pytest.approx(want[i], abs=1e-6) for i in near)


def test_derived_tables_are_dealt_before_their_geometry(spark):
    """A table of one small file has its rings and lines made by all cores."""
    for name in ("parcels", "layers"):
        assert derived(spark, "/root/testdata/sf0.001", name).rdd.getNumPartitions() >= 8
