import math

import pytest
from pyspark.sql import functions as F

from parcelfusion.functions import geometry as G
from parcelfusion.functions import kernels as K
from parcelfusion.functions import shapes as S

RING = "array<struct<x:double,y:double>>"


def pts(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def box(x, y, w, h):
    return pts((x, y), (x + w, y), (x + w, y + h), (x, y + h))


L_SHAPE = pts((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10))


def values(spark, schema, rows, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_measures(spark):
    ring = F.col("ring")
    got = values(spark, f"ring {RING}", [(box(0, 0, 10, 10),), (L_SHAPE,), (L_SHAPE[::-1],)], area=G.area(ring), p=G.perimeter(ring), c=G.compactness(ring), g=G.centroid(ring), b=G.bbox(ring, 1.0), turned=G.signed_area(G.ccw(ring)))
    assert [r["area"] for r in got] == [100.0, 64.0, 64.0]
    assert [r["p"] for r in got] == [40.0, 40.0, 40.0]
    assert got[0]["c"] == pytest.approx(math.pi / 4)
    assert (got[0]["g"].x, got[0]["g"].y) == (5.0, 5.0)
    assert got[1]["g"].x == pytest.approx((40 * 5 + 24 * 2) / 64)
    assert tuple(got[0]["b"]) == (-1.0, -1.0, 11.0, 11.0)
    assert got[2]["turned"] == 64.0


@pytest.mark.parametrize(
    ("a", "b", "area"),
    [(box(0, 0, 10, 10), box(8, 0, 10, 10), 20.0), (L_SHAPE, L_SHAPE, 64.0), (L_SHAPE, L_SHAPE[::-1], 64.0), (box(0, 0, 1, 1), box(5, 5, 1, 1), 0.0), (L_SHAPE, box(5, 5, 9, 9), 0.0), (L_SHAPE, box(3, 3, 4, 4), 7.0), (box(0, 0, 4, 4), pts((2, -2), (6, 2), (2, 6), (-2, 2)), 16.0)],
)
def test_intersection(spark, a, b, area):
    (got,) = values(spark, f"a {RING}, b {RING}", [(a, b)], ab=G.intersection_area(F.col("a"), F.col("b")), ba=G.intersection_area(F.col("b"), F.col("a")))
    assert got["ab"] == pytest.approx(area) and got["ba"] == pytest.approx(area)


def test_null_and_empty_rings(spark):
    got = values(spark, f"a {RING}, b {RING}", [(None, box(0, 0, 1, 1)), ([], box(0, 0, 1, 1)), (box(0, 0, 1, 1), box(0, 0, 1, 1))], x=G.intersection_area(F.col("a"), F.col("b")))
    assert [r["x"] for r in got] == [None, None, 1.0]


def test_predicates(spark):
    rows = [(box(0, 0, 10, 10), x, y) for x, y in [(5, 5), (10.5, 5), (11, 5), (-3, 5), (60, 5)]]
    ring, x, y = F.col("ring"), F.col("x"), F.col("y")
    got = values(spark, f"ring {RING}, x double, y double", [(r, float(a), float(b)) for r, a, b in rows], inside=G.contains_point(ring, x, y), near=G.contains_within(ring, x, y, 0.75))
    assert [(r["inside"], r["near"]) for r in got] == [(True, True), (False, True), (False, False), (False, False), (False, False)]
    df = spark.createDataFrame([(box(0, 0, 10, 10), pts((-5, 5), (20, 5))), (box(0, 0, 10, 10), pts((13, 0), (13, 9))), (box(0, 0, 10, 10), pts((2, 2), (3, 3))), (box(0, 0, 10, 10), pts((13, 14)))], f"ring {RING}, line {RING}")
    df = df.select(S.of_ring(ring).alias("p"), S.of_line(F.col("line")).alias("l"))
    got = df.select(S.meets(F.col("p"), F.col("l")).alias("meets"), S.distance(F.col("p"), F.col("l")).alias("d")).collect()
    assert [(r["meets"], r["d"]) for r in got] == [(True, 0.0), (False, 3.0), (True, 0.0), (False, 5.0)]


def test_self_crossing_and_parts(spark):
    bow = pts((0, 0), (10, 10), (10, 0), (0, 10))
    got = values(spark, f"ring {RING}", [(bow,), (L_SHAPE,), (box(0, 0, 1, 1),)], bad=G.crosses_itself(F.col("ring")))
    assert [r["bad"] for r in got] == [True, False, False]
    (got,) = values(spark, f"parts array<{RING}>", [([box(0, 0, 1, 1), box(0, 0, 3, 3), box(9, 9, 3, 3)],)], r=G.largest_part(F.col("parts")))
    assert [tuple(p) for p in got["r"]] == [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]


def test_hausdorff_and_blocks(spark):
    (got,) = values(spark, f"a {RING}, b {RING}", [(box(0, 0, 10, 10), box(3, 0, 10, 10))], h=G.hausdorff(F.col("a"), F.col("b")), v=G.vertex_ratio(F.col("a"), F.col("b")), m=G.lod1(F.col("a"), F.lit(430.0), F.lit(5.0)))
    assert got["h"] == 3.0 and got["v"] == 1.0 and got["m"].roof_elevation == 435.0 and got["m"].volume == 500.0 and got["m"].roof[0].z == 435.0


def test_utm(spark):
    rows = [(76.9558, 11.0168, 43), (72.0, -33.5, 43), (80.2, 13.1, 44)]
    zone = G.utm_zone(F.col("lon"))
    m = G.to_utm(F.col("lon"), F.col("lat"), zone)
    df = spark.createDataFrame(rows, "lon double, lat double, z int").select("*", zone.alias("zone"), m.alias("m"))
    back = F.when(F.col("lat") >= 0, G.from_utm(F.col("m.x"), F.col("m.y"), F.col("zone"))).otherwise(G.from_utm(F.col("m.x"), F.col("m.y"), F.col("zone"), north=False))
    for r in df.select("*", back.alias("b")).collect():
        assert r.zone == r.z and abs(r.b.x - r.lon) < 1e-7 and abs(r.b.y - r.lat) < 1e-7
    first = df.first()
    assert 700_000 < first.m.x < 730_000 and 1_200_000 < first.m.y < 1_230_000


def test_overlap_invariants():
    import numpy as np

    rng = np.random.default_rng(4)

    def star(n):
        angle, r = np.sort(rng.random(n)) * 2 * np.pi, 1 + rng.random(n) * 3
        return np.column_stack([5 + r * np.cos(angle), 5 + r * np.sin(angle)]).ravel()

    a, b = [star(9) for _ in range(40)], [star(6) for _ in range(40)]
    inter = K.overlap(K.Rings(a), K.Rings(b))
    own_a, own_b = K.overlap(K.Rings(a), K.Rings(a)), K.overlap(K.Rings(b), K.Rings(b))
    assert np.allclose(inter, K.overlap(K.Rings(b), K.Rings(a)))
    assert (inter <= np.minimum(own_a, own_b) + 1e-9).all() and (inter >= 0).all()
    grid = rng.random((200_000, 2)) * 10
    hit = K.within(K.Rings([a[0]] * len(grid)), grid, 0.0) & K.within(K.Rings([b[0]] * len(grid)), grid, 0.0)
    assert abs(hit.mean() * 100 - inter[0]) < 0.7
