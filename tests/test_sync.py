"""Changes of whole records, upserts with nulls, snapshots that advance in a stream, repair of crossings, and rules of names."""

import pytest
from pyspark.sql import functions as F

from parcelfusion.functions.text import standard_land_use
from parcelfusion.operators import raster as P
from parcelfusion.operators import sync as Y
from parcelfusion.operators.four_files import reconcile_files
from parcelfusion.operators.relational import search
from parcelfusion.operators.topology import largest_loop, loops, repaired, signed
from parcelfusion.sources import readers as I
from parcelfusion.streaming.features import sync_stream

SIDE = "feature_id long, parcel_id string, area double, land_use string, geom_key string, props map<string,string>, seq int"


@pytest.fixture
def side(spark):
    return lambda *rows: spark.createDataFrame([(*r, 1) if len(r) == 6 else r for r in rows], SIDE)


def found(df):
    return {(r.feature_id, r.parcel_id): (r.change, tuple(r.changed)) for r in df.collect()}


def test_any_property_counts(side):
    old = side((1, "a", 1.0, "R", "g", {"x": "1"}), (2, "b", 1.0, "R", "g", {"x": "1"}), (3, "c", 1.0, None, "g", None), (4, "d", 1.0, "R", "g", {}), (5, "e", 1.0, "R", "g", {"k": "v"}), (6, "f", 1.0, "R", "g", {"y": None}), (7, "h", 1.0, "R", None, {}))
    new = side((1, "a", 1.0, "C", "g", {"x": "1"}), (2, "b", 2.0, "C", "g", {"x": "2", "z": "3"}), (3, "c", 1.0, None, "g", None), (4, "d", 2.0, "C", "h", {}), (5, "e", 1.0, "R", "g", {}), (6, "f", 1.0, "R", "g", {}), (8, "i", 1.0, "R", None, {}))
    got = Y.changes(old, new)
    assert found(got) == {(1, "a"): ("ATTRIBUTE_CHANGED", ("land_use",)), (2, "b"): ("AREA_CHANGED", ("area", "land_use", "x", "z")), (4, "d"): ("GEOMETRY_CHANGED", ("area", "land_use")), (5, "e"): ("ATTRIBUTE_CHANGED", ("k",)), (7, "h"): ("REMOVED", ()), (8, "i"): ("ADDED", ())}
    hashes = {r.feature_id: (r.previous_hash, r.current_hash) for r in got.collect()}
    assert hashes[7][1] is None and hashes[8][0] is None and hashes[1][0] != hashes[1][1]


def test_null_and_repeated_ids(side):
    old = side((None, "a", 1.0, "R", "g", {}), (None, "b", 1.0, "R", "g", {}), (1, "c", 1.0, "stale", "g", {}, 1), (1, "c", 1.0, "R", "g", {}, 2))
    new = side((None, "a", 1.0, "R", "g", {}), (None, "a", 1.0, "R", "g", {}), (None, "n", 1.0, "R", "g", {}), (1, "c", 1.0, "R", "g", {}, 5), (1, "c", 1.0, "old", "g", {}, 4))
    assert found(Y.changes(old, new, order="seq")) == {(None, "b"): ("REMOVED", ()), (None, "n"): ("ADDED", ())}
    assert found(Y.changes(old.limit(0), new.limit(0))) == {}


def test_upsert_of_null_keys(spark):
    now = spark.createDataFrame([(1, 1, "a"), (None, 1, "b"), (2, 1, "c")], "id long, seq int, v string")
    batch = spark.createDataFrame([(None, 2, "x"), (None, 3, "y"), (2, 5, "z")], "id long, seq int, v string")
    assert sorted(map(tuple, Y.upsert(now, batch, "id", "seq").collect()), key=str) == sorted([(1, 1, "a"), (None, 3, "y"), (2, 5, "z")], key=str)


def test_snapshot_advances_between_batches(spark, side, tmp_path):
    """A feature that changes twice is compared with what the first batch left; a batch that runs again changes nothing."""
    base = side((1, "a", 1.0, "R", "g", {}), (2, "b", 1.0, "R", "g", {}))
    rows = [[(1, "a", 1.0, "C", "g", {}), (2, "b", 1.0, "R", "g", {}), (3, "n", 1.0, "R", "g", {})], [(1, "a", 1.0, "C", "g2", {}), (3, "n", 1.0, "R", "g", {})], [(1, "a", 1.0, "C", "g2", {}), (3, "n", 9.0, "R", "g", {})]]

    def run():
        stream = spark.readStream.schema(base.drop("seq").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        sync_stream(stream, base.drop("seq"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return sorted((r.batch, r.feature_id, r.change, r.previous_version, r.version) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for batch in rows[:2]:
        side(*batch).drop("seq").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        first = run()
    assert first == [(0, 1, "ATTRIBUTE_CHANGED", 1, 2), (0, 3, "ADDED", None, 1), (1, 1, "GEOMETRY_CHANGED", 2, 3)]
    # The last batch as if it had not been committed: it is worked on once more.
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "checkpoint" / name).unlink(missing_ok=True)
    side(*rows[2]).drop("seq").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [*first, (2, 3, "AREA_CHANGED", 1, 2)]


def test_repair_of_several_crossings(spark):
    two = [(0, 0), (30, 0), (30, 10), (10, -10), (10, 10), (0, 10)]
    three = [(0, 0), (12, 12), (20, 4), (28, 12), (28, 0), (20, 8), (12, 0), (0, 12)]
    spike = [(0, 0), (16, 0), (16, 16), (16, 0), (32, 0), (32, 8)]
    for ring, n, area in ((two, 3, 100.0), (three, 4, 72.0)):
        ring = [(float(x), float(y)) for x, y in ring]
        assert len(loops(ring)) == n and abs(signed(largest_loop(ring))) == area
        moved = [(x + 700_000.25, y + 1_200_000.5) for x, y in ring]
        assert abs(signed(largest_loop(moved[3:] + moved[:3]))) == area
    assert largest_loop([(float(x), float(y)) for x, y in spike]) is None and largest_loop([(0.0, 0.0)] * 4) is None
    ring = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate((two, three, spike, two[:2] + [(30, 10)]))], f"parcel_id long, ring {ring}")
    assert {r.parcel_id: r.outcome for r in repaired(df).collect()} == {0: "REPAIRED", 1: "REPAIRED", 2: "QUARANTINED"}


def test_four_files_with_what_goes_wrong(spark, tmp_path):
    """A bow-tie is repaired and matched, a parcel without geometry keeps its row, metric files stay as they are."""
    square = lambda x, y, w: [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]
    x, y = 700_000.0, 1_200_000.0
    bow = [[x + 100, y], [x + 140, y + 40], [x + 140, y], [x + 100, y + 40], [x + 100, y]]
    feature = lambda props, rings: {"type": "Feature", "properties": props, "geometry": rings and {"type": "Polygon", "coordinates": [rings]}}
    crs = '"crs": {"properties": {"name": "EPSG:32643"}}, '
    write = lambda name, features: (tmp_path / name).write_text(I.as_json_text(features).replace('"features"', crs + '"features"', 1))
    write("legacy.geojson", [feature({"parcel_id": "P1", "survey_no": "10", "subdivision_no": "1", "land_use": "Residential"}, square(x, y, 40)), feature({"parcel_id": "P2", "survey_no": "11"}, bow), feature({"parcel_id": "P3", "survey_no": "12"}, None)])
    write("drone.geojson", [feature({"feature_id": "F1", "survey_candidate": "10/1"}, square(x, y, 40)), feature({"feature_id": "F2", "survey_candidate": "11/1"}, [[x + 120, y + 20], bow[2], bow[1], [x + 120, y + 20]])])
    (tmp_path / "gnss.csv").write_text("point_id,survey_no,latitude,longitude\n1,10/1,10.85,76.83\n2,10/1,bad,76\n")
    (tmp_path / "revenue.csv").write_text("survey_no,subdivision_no,owner_ref,area,land_use,status\n10,1,H1,1600,Residential,Active\n10,1,H2,1601,Residential,Active\n")
    run = reconcile_files(spark, *(str(tmp_path / f) for f in ("legacy.geojson", "drone.geojson", "gnss.csv", "revenue.csv")))
    got = {r.parcel_id: r for r in run.parcels.collect()}
    assert set(got) == {"P1", "P2", "P3"} and got["P1"].feature_id == "F1" and got["P1"].iou == pytest.approx(100.0) and got["P1"].rev_owner_ref == "H2" and got["P1"].area == 1600.0
    assert got["P2"].feature_id == "F2" and got["P2"].iou == pytest.approx(100.0) and got["P2"].area == 400.0 and got["P3"].feature_id is None and got["P3"].conflict.type == "Missing"
    assert [(r.id, r.outcome) for r in run.repairs.collect()] == [("P2", "REPAIRED")]


def test_rules_of_names(spark):
    uses = spark.createDataFrame([("mixed-use plot 2b",), ("o'neil park",), (" green  belt ",), (None,)], "u string").select(standard_land_use(F.col("u")).alias("u"))
    assert [r.u for r in uses.collect()] == ["Mixed-Use Plot 2B", "O'Neil Park", "Green  Belt", None]
    bands = spark.createDataFrame([(i, 10, 10, i, 0.5, "metre") for i in (1, 2, 3, 4, 5)], "raster_id int, width int, height int, bands int, res_x double, unit string")
    assert [r.band_names for r in P.registered(bands).orderBy("raster_id").collect()] == ["Panchromatic/Grayscale", "Red,Green,Blue", "Red,Green,Blue", "Red,Green,Blue,Near-Infrared (NIR)", "Red,Green,Blue"]
    regions = spark.createDataFrame([(40.0, 30), (-40.0, 30), (20.0, 30), (20.0, 1500), (5.0, 30)], "d double, n int").select(P.region_class(F.col("d"), F.col("n"), F.col("n") * 0.25).alias("c")).select("c.*")
    assert [(r.kind, r.confidence) for r in regions.collect()] == [("BUILDING_ADDED", 93.5), ("BUILDING_REMOVED", 91.0), ("BUILDING_EXPANSION", 89.5), ("SIGNIFICANT_LAND_COVER_CHANGE", 88.0), ("SIGNIFICANT_LAND_COVER_CHANGE", 88.0)]
    names = spark.createDataFrame([("A\\b%c",), ("axb",), ("É",)], "n string")
    assert [r.n for r in search(names, "a_b", ["n"], "n", wildcards=True).collect()] == ["A\\b%c", "axb"]
    assert [r.n for r in search(names, "\\b", ["n"], "n", wildcards=True).collect()] == ["A\\b%c"] and search(names, "é", ["n"], "n").count() == 0


def test_opening_and_closing_by_tiles(spark):
    """As one grid gives it, whatever the tiles: blocks across tile borders, holes, spots, negative places."""
    import numpy as np

    rng = np.random.default_rng(5)
    grid = np.zeros((60, 70), bool)
    for _ in range(25):
        r, c, h, w = rng.integers(5, 45), rng.integers(5, 50), rng.integers(1, 12), rng.integers(1, 14)
        grid[r : r + h, c : c + w] = True
    grid &= rng.random(grid.shape) > 0.02
    want = grid
    for keep in (np.logical_and, np.logical_or, np.logical_or, np.logical_and):
        wide = np.pad(want, 1)
        want = keep.reduce([wide[i : i + 60, j : j + 70] for i in range(3) for j in range(3)])
    rows = [(int(r) - 20, int(c) - 30) for r, c in zip(*np.nonzero(grid), strict=True)]
    df = spark.createDataFrame([*rows, *rows[:9], (None, 3)], "px_row int, px_col int")
    for tile in (4, 16, 256):
        assert sorted(map(tuple, P.opened_closed(df, tile).collect())) == [(int(r) - 20, int(c) - 30) for r, c in zip(*np.nonzero(want), strict=True)]
    plan = P.opened_closed(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def labelled(places):
    """Regions by a flood fill: place -> smallest place."""
    left, out = set(places), {}
    for start in sorted(left):
        todo = [start] if start in left else []
        left.discard(start)
        while todo:
            r, c = todo.pop()
            out[r, c] = start
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
    return out


def test_regions_over_tiles(spark):
    """As a flood fill gives them: noise, corners that meet at a tile's corner, repeated rows, places below zero; none of none."""
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [(int(r) - 20, int(c) - 15) for r, c in zip(*np.nonzero(rng.random((40, 45)) < 0.42), strict=True)]
    want = labelled(rows)
    assert len(set(want.values())) > 5
    df = spark.createDataFrame([*rows, *rows[:9], (None, 3), (4, None)], "px_row int, px_col int")
    for tile in (4, 256):
        out = P.regions(df, tile).collect()
        assert len(out) == len(want) and {(r.px_row, r.px_col): tuple(r.region) for r in out} == want
    corner = spark.createDataFrame([(3, 3), (4, 4), (3, 8), (4, 7), (9, 9)], "px_row int, px_col int")
    assert len({tuple(r.region) for r in P.regions(corner, 4).collect()}) == 3
    assert P.regions(df.limit(0)).count() == 0


def test_a_spiral_over_a_hundred_tiles_ends_soon(spark, monkeypatch):
    """One region whatever the way from its start to its end; the rounds follow the logarithm of its tiles."""
    place, seen, (dr, dc) = (0, 0), {(0, 0)}, (0, 1)
    for n in [39, *(k for k in range(39, 2, -2) for _ in (0, 1))]:
        for _ in range(n):
            place = (place[0] + dr, place[1] + dc)
            seen.add(place)
        dr, dc = dc, -dr
    spiral = sorted(seen)
    written = []
    stored = P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: written.append(name) or stored(df, name))
    out = P.regions(spark.createDataFrame(spiral, "px_row long, px_col long"), 4).collect()
    assert len(out) == len(spiral) and {tuple(r.region) for r in out} == {(0, 0)} and set(labelled(spiral).values()) == {(0, 0)}
    assert written.count("links") <= 8 and written.count("links-up") <= 30


def test_windows_scan_the_tiles_they_meet(spark, tmp_path):
    """As the plain filter gives them, edges of box and tiles included; pixels without a place are in none."""
    rows = [(1, float(x), float(y), float(x * y)) for x in range(-20, 21, 2) for y in range(-20, 21, 2)] + [(1, None, 3.0, 0.0), (1, 2.0, None, 0.0)]
    pixels = spark.createDataFrame(rows, "raster_id long, x double, y double, elev double")
    P.write_tiles(pixels, str(tmp_path / "tiles"), 8.0)
    tiled = spark.read.parquet(str(tmp_path / "tiles"))
    assert tiled.count() == len(rows)
    for box in ((-16.0, -8.0, 8.0, 7.5), (0.0, 0.0, 0.0, 0.0), (30.0, 30.0, 40.0, 40.0), (-99.0, -99.0, 99.0, 99.0)):
        out = P.tile_window(tiled, box, 8.0)
        assert out.columns == pixels.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, P.window(pixels, box).collect()))
    plan = P.tile_window(tiled, (0.0, 0.0, 4.0, 4.0), 8.0)._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "tile_x" in pruned and "tile_y" in pruned
