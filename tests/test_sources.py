import json

from pyspark.sql import functions as F

from parcelfusion.operators import georeference as Q
from parcelfusion.operators import harmonize as H
from parcelfusion.operators import raster as P
from parcelfusion.operators import topology as T
from parcelfusion.sources import readers as I
from parcelfusion.sources import writers as O
from test_geometry import RING, box, pts


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def poly(*xy):
    return {"type": "Polygon", "coordinates": [[list(p) for p in (*xy, xy[0])]]}


def test_legacy_and_drone_geojson(spark, tmp_path):
    a, b = poly((0, 0), (2, 0), (2, 2), (0, 2)), {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [8, 5], [8, 8], [5, 8], [5, 5]]]]}
    text = json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:32643"}}, "features": [
        {"type": "Feature", "properties": {"survey_no": "184", "subdivision_no": "2", "area": "7.5", "odd": "kept"}, "geometry": a}, {"type": "Feature", "id": "x9", "properties": {"area": "bad"}, "geometry": b}]})
    got = I.legacy_parcels(spark, put(tmp_path, "l.geojson", text)).collect()
    assert [(r.parcel_id, r.full_survey, r.area, r.crs) for r in got] == [("P001", "184/2", 7.5, "EPSG:32643"), ("P002", "102/1", 9.5, "EPSG:32643")]
    assert got[0].props["odd"] == "kept" and len(got[1].ring) == 4
    assert [r.feature_id for r in I.drone_features(spark, put(tmp_path, "d.geojson", text)).collect()] == ["FE_001", "x9"]


def test_csv_defaults(spark, tmp_path):
    g = I.gnss_points(spark, put(tmp_path, "g.csv", "point_id,survey_no,lat,lng,accuracy\nA, 1/1 ,11.5,76.9,0.5\nB,2,oops,76.9,\nC,3,11.6,76.8,\n")).collect()
    assert [(r.point_id, r.survey_no, r.latitude, r.accuracy_m) for r in g] == [("A", "1/1", 11.5, 0.5), ("C", "3", 11.6, 0.03)]
    r = I.revenue_rows(spark, put(tmp_path, "r.csv", "survey_no,area,land_use\n5,none, Dry \n6,12.5,\n")).collect()
    assert [(x.survey_no, x.area, x.land_use, x.status, x.subdivision_no) for x in r] == [("5", 1000.0, "Dry", "Active", ""), ("6", 12.5, "Residential", "Active", "")]


def test_layers_roads_districts(spark, tmp_path):
    line = {"type": "LineString", "coordinates": [[0, 0], [10, 4]]}
    roads = put(tmp_path, "roads.geojson", json.dumps({"type": "FeatureCollection", "features": [{"id": "r1", "properties": {}, "geometry": line}, {"properties": {"district_code": "7", "district_name": "D", "total_population": "12"}, "geometry": {"type": "Point", "coordinates": [50, 60]}}]}))
    df = I.layers(spark, {"road": roads})
    assert [(r.layer, r.feature_id, r.minx, r.maxy) for r in df.orderBy("pos" if "pos" in df.columns else "minx").collect()] == [("road", "r1", 0.0, 4.0), ("road", "road_1", 50.0, 60.0)]
    assert I.inside_box(df, (40, 40, 70, 70)).count() == 1
    assert [r.utility_id for r in I.utilities(spark, roads).collect()] == ["r1", "UTIL_002"]
    assert [(r.district_name, r.total_population) for r in I.districts(spark, roads).collect()] == [("", 0.0), ("D", 12.0)]
    csv = put(tmp_path, "road.csv", 'city,zone,ward,no,total,tar,concrete,both,one\nKovai,Z," W, 1 ",7,420.5 km,12 km,-,1 km,2.5 km,,\nKovai,Z,W,7,1 km,2 km,3 km,4 km\n ,Z,W,7,1,2,3,4,5\n')
    (r,) = I.road_inventory(spark, csv).collect()
    assert tuple(r) == ("Kovai", "Z", "W, 1", "7", "420.5 km", "12 km", "-", "1 km", "2.5 km", 420.5, 12.0, None, 1.0, 2.5)


def test_positions_over_files_and_blocks(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    for k in range(3):
        (folder / f"part-{k}.json").write_text("".join(json.dumps({"properties": {"area": str(1000 * k + i)}, "geometry": None}) + "\n" for i in range(700)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = I.legacy_parcels(spark, str(folder), lines=True).select("parcel_id", "survey_no", "area").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(f"P{n + 1:03d}", str(n + 101), float(1000 * (n // 700) + n % 700)) for n in range(2100)}
    assert {tuple(r) for r in got} == want and len(got) == 2100


def test_one_layer_reads_one_folder(spark, tmp_path):
    O.write_layers(spark.createDataFrame([("road", 1, 0.0), ("water", 2, 5.0)], "layer string, feature_id long, minx double"), str(tmp_path / "layers"))
    one = I.layer(spark, str(tmp_path / "layers"), "road")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert [r.feature_id for r in one.collect()] == [1] and "PartitionFilters: [isnotnull(layer" in plan
    boxed = spark.read.parquet(str(tmp_path / "layers")).where("minx <= 2")
    assert "PushedFilters: [IsNotNull(minx), LessThanOrEqual(minx,2.0)]" in boxed._jdf.queryExecution().executedPlan().toString()


def test_header_mapping_against_a_loop(spark):
    from difflib import SequenceMatcher

    from parcelfusion.functions.text import SYNONYMS

    headers = ["Survey_No", "khasra", "ownername!", "Land Usee", "total areas", "zzz", "ID", "Gid "]

    def plain(h):
        k = "".join(c for c in h.strip().lower() if c.isascii() and c.isalnum())
        bare = lambda s: s.replace("_", "")
        for c in SYNONYMS:
            if k == bare(c):
                return c, 100.0
        for c, ss in SYNONYMS.items():
            if k in map(bare, ss):
                return c, 96.0
        r, c = max(((SequenceMatcher(None, k, bare(s)).ratio(), c) for c, ss in SYNONYMS.items() for s in ss), key=lambda x: x[0])
        return (c, round(r * 100, 1)) if r >= 0.78 else (None, 0.0)

    got = {r.header: (r.canonical, r.confidence) for r in H.header_mapping(spark.createDataFrame([(h,) for h in headers], "header string")).collect()}
    assert got == {h: plain(h) for h in headers}


def test_canonical_columns(spark):
    df = spark.createDataFrame([("7", "1", "x")], "khasra string, hissa_no string, other string")
    r = H.canonical_columns(df, {"khasra": "survey_no", "hissa_no": "subdivision_no"}).first()
    assert (r.survey_no, r.full_survey, r.other) == ("7", "7/1", "x")


def test_repair_and_boundaries(spark):
    bow, star = pts((0, 0), (10, 10), (10, 0), (0, 6)), pts((0, 0), (10, 1), (0, 2), (10, 3), (5, -5))
    df = spark.createDataFrame([(1, bow), (2, box(0, 0, 1, 1)), (3, star)], f"parcel_id long, ring {RING}")
    got = {r.parcel_id: r for r in T.repaired(df).collect()}
    assert got[1].outcome == "REPAIRED" and len(got[1].repaired) == 3 and got[1].original_wkt.startswith("POLYGON ((0.0 0.0") and got[3].outcome == "REPAIRED" and 2 not in got
    pair = spark.createDataFrame([(1, 2, box(0, 0, 10, 10), box(8, 0, 10, 10), 20.0)], f"a long, b long, ring_a {RING}, ring_b {RING}, overlap double")
    got = {r.strategy: (r.overlap, r.a_after, r.b_after) for r in T.shared_boundary(pair).collect()}
    assert got == {"PRIORITIZE_A": (20.0, 100.0, 80.0), "PRIORITIZE_B": (20.0, 80.0, 100.0), "BISECT": (20.0, 90.0, 90.0)}


def test_affine_and_regions(spark, tmp_path):
    pts_ = [(1, k, float(x), float(y), 2.0 * x - 0.5 * y + 700, 0.25 * x + 3.0 * y - 9) for k, (x, y) in enumerate([(0, 0), (90, 3), (5, 80), (77, 66)])] + [(2, 9, 0.0, 0.0, 1.0, 1.0)]
    points = spark.createDataFrame(pts_, "sheet_id long, point_id long, img_x double, img_y double, map_x double, map_y double")
    fit = Q.affine_fit(points)
    (r,) = Q.residuals(points, fit).collect()
    assert r.sheet_id == 1 and r.rmse < 0.001 and r.accepted
    assert {x.point_id: round(x.x, 6) for x in Q.to_map(points, fit).where("x is not null").collect()} == {k: u for s, k, *_, u, _ in pts_ if s == 1}
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    snake = [(r, c) for r in range(0, 9, 2) for c in range(9)] + [(r, 8 if r % 4 == 1 else 0) for r in range(1, 8, 2)] + [(20, 20), (21, 21)]
    labels = P.regions(spark.createDataFrame(snake, "px_row long, px_col long"))
    assert sorted(r["count"] for r in labels.groupBy("region").count().collect()) == [2, len(snake) - 2]
    square = spark.createDataFrame([(r, c) for r in range(5) for c in range(5)] + [(9, 9)], "px_row long, px_col long")
    assert P.opened_closed(square).count() == 25
