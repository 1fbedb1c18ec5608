"""What grows with pairs and points: who is tested against a shape, what is worked on at once, what is computed once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelfusion.functions import kernels as K
from parcelfusion.functions import shapes as S
from parcelfusion.operators import matching as M
from parcelfusion.operators import raster as P
from parcelfusion.plans.fixtures import derived
from test_geometry import RING, box
from test_matching import DRONE, GNSS, PARCEL


@pytest.fixture(scope="module")
def sides(spark):
    parcels = [(i, str(i), "1", f"{i}/1", 1600.0, "Residential", box(i * 40.0, 0, 40, 40)) for i in range(4)]
    drone = [(f"f{i}", f"{i}/1", "", 1600.0, box(i * 40.0 + 0.5, 0, 40, 40)) for i in range(4)]
    points = [(f"{i}/1", k, i * 40.0 + 5 + k, 20.0) for i in range(4) for k in range(10)] + [("0/1", 90, None, None), ("0/1", 91, 1e9, 1e9), ("0/1", 92, 0.0, 20.0), ("0/1", 93, -0.5, 20.0)]
    return spark.createDataFrame(parcels, PARCEL), spark.createDataFrame(drone, DRONE).where("feature_type = ''"), spark.createDataFrame(points, GNSS)


def test_points_outside_a_candidates_box_do_not_reach_its_shape(sides):
    p, d, g = sides
    pairs = M.pairs_of(M.with_gnss_key(p, g), d)
    counted = M.gnss_inside(pairs, g)
    got = {(r.parcel_id, r.feature_id): (r.points, r.inside) for r in counted.collect()}
    # All of a parcel's points are counted, those without coordinates and far away too; of parcel 0, the point on x = 0 is 0.5 off its candidate, the next one farther than the margin.
    assert got[0, "f0"] == (14, 11) and got[1, "f1"] == (10, 10) and got[0, "f1"] == (14, 0) and got[2, "f1"] == (10, 0)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line and "gnss_key" in line)
    assert "gx" in join and "minx" in join
    bare = M.gnss_inside(pairs.drop("d_box"), g)  # a caller's pairs without boxes
    assert {(r.parcel_id, r.feature_id): (r.points, r.inside) for r in bare.collect()} == got


def test_polygons_are_measured_once_and_pairs_carry_boxes(sides):
    p, d, g = sides
    pairs = M.pairs_of(M.with_gnss_key(p, g), d)
    assert {"d_box", "m", "d_m"} <= set(pairs.columns)
    scans = M.candidates(*(t.withColumn("shape", S.of_ring(F.col("ring"))) for t in (p, d)))
    assert {(r.parcel_id, r.feature_id) for r in pairs.collect()} == {(r.parcel_id, r.feature_id) for r in scans.collect()}


def test_blocks_waste_at_most_half_and_cover_all_rows():
    sizes = np.array([640] * 300 + [40] * 300 + [0, 5, 200_000, 3, 640])
    seen = []
    for rows in K.blocks(sizes, 1 << 14):
        mine = sizes[rows]
        assert len(mine) == 1 or (len(mine) * mine.max() <= 1 << 14 and mine.max() <= 2 * mine.min() + 32)
        seen += range(rows.start, rows.stop)
    assert seen == list(range(len(sizes)))


def test_lists_keep_rows_through_masks_and_slices():
    import pyarrow as pa

    lists = K.Lists.of(pa.array([[1.0, 2.0], None, [], [3.0], [4.0, 5.0, 6.0]]))
    assert lists.n.tolist() == [2, 0, 0, 1, 3] and lists[1:4].values.tolist() == [3.0]
    assert lists[np.array([True, False, True, False, True])].values.tolist() == [1.0, 2.0, 4.0, 5.0, 6.0]
    assert K.Lists.of(pa.array([[9.0], [1.0, 2.0], [7.0]]).slice(1, 1)).values.tolist() == [1.0, 2.0]


def test_scanlines_of_a_kernel_are_the_pixels_inside(spark):
    rng = np.random.default_rng(5)
    rings = [[(float(np.floor(x * 8) / 8), float(np.floor(y * 8) / 8)) for x, y in np.column_stack([np.cos(t), np.sin(t)]) * rng.uniform(3, 150) + rng.uniform(-200, 200, 2)] for t in (np.sort(rng.uniform(0, 6.2, 7)) for _ in range(20))]
    parcels = spark.createDataFrame([*[(f"p{i}", [dict(x=x, y=y) for x, y in r]) for i, r in enumerate(rings)], ("none", None)], f"parcel_id string, ring {RING}")
    lines = P.scanlines(parcels, 2.0, 8)
    assert "MapInArrow" in lines._jdf.queryExecution().executedPlan().toString()
    got = lines.collect()
    assert all(np.floor(r.x0 / 16) <= r.cell <= np.floor(r.x1 / 16) for r in got)
    met = {(r.parcel_id, r.row, r.x0, r.x1) for r in got}
    for i, ring in enumerate(rings):
        shape = K.Shapes(K.Lists.of([np.array(ring).ravel()]), K.Lists.of([np.array([len(ring)])]), np.array([2]))
        xs, rows = np.arange(-400, 400) + 0.3, range(-200, 200)
        for row in rows:
            spots = np.column_stack([xs, np.full(len(xs), row * 2.0)])
            want = K.holds(shape, spots, np.zeros(len(xs), np.int64))
            mine = np.zeros(len(xs), bool)
            for p, r, x0, x1 in met:
                if p == f"p{i}" and r == row:
                    mine |= (xs >= x0) & (xs < x1)
            assert (mine == want).all()


def test_only_pairs_that_may_lead_are_compared(spark):
    """Boundaries, overlaps and survey points of a parcel's other candidates took most of the time, though only its first one was asked for."""
    sf = "/root/testdata/sf0.001"
    p, d, g = (derived(spark, sf, n) for n in ("parcels", "drone", "gnss"))
    every, some = M.evidence(p, d, g).persist(), M.evidence(p, d, g, best=40.0).persist()
    assert some.count() * 4 < every.count()
    names = ["parcel_id", "feature_id", "score", "iou", "mean_dev", "hausdorff", "gnss_pct", "flags", "d_area"]
    rows = lambda df: sorted(map(str, M.best_matches(p, df).select(*names).collect()))
    assert rows(some) == rows(every) and M.best_matches(p, some).where("score is not null").count() > 0
    scores = lambda df: sorted(map(str, M.ranked(df).select("parcel_id", "feature_id", "score", "rank").collect()))
    assert scores(M.evidence(p, d, g, scores=True)) == scores(every)


def test_marks_of_cells_lose_no_point_inside_a_box(spark):
    """Only pairs whose box shares a marked cell with the parcel's points are joined with them."""
    boxes = spark.range(40).selectExpr("id", "struct(id * 13.7 - 200 AS minx, id * 7.1 - 90 AS miny, id * 13.7 - 200 + id * id AS maxx, id * 7.1 - 60 AS maxy) AS box")
    points = boxes.selectExpr("cast(id AS string) AS survey_no", "explode(sequence(0, 10)) AS i", "box").selectExpr("survey_no", "box.minx - 0.75 + (box.maxx - box.minx + 1.5) * i / 10 AS x", "box.miny - 0.75 + (box.maxy - box.miny + 1.5) * ((i * 7) % 11) / 10 AS y")
    marks = points.selectExpr("concat(survey_no, '-', x) AS survey_no", "x", "y")
    one = M.gnss_marks(marks).selectExpr("cast(split(gnss_key, '-')[0] AS long) AS id", "marks", "points")
    met = boxes.withColumn("box_marks", M.box_marks(F.col("box"))).join(one.hint("merge"), "id")
    assert met.count() > 300 and met.where("marks & box_marks = 0").isEmpty()
