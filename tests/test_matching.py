"""Adversarial parcels, one table of cases through the whole matching path."""

import pytest
from pyspark.sql import functions as F

from parcelfusion.functions import kernels as K
from parcelfusion.functions import scoring as S
from parcelfusion.functions import text as X
from parcelfusion.operators import layers as L
from parcelfusion.operators import matching as M
from parcelfusion.operators import reconcile as R
from test_geometry import RING, box, pts

PARCEL = f"parcel_id long, survey_no string, subdivision_no string, full_survey string, area double, land_use string, ring {RING}"
DRONE = f"feature_id string, survey_candidate string, feature_type string, area double, ring {RING}"
GNSS = "survey_no string, seq long, x double, y double"


def far(i):
    return i * 1000.0


@pytest.fixture(scope="module")
def best(spark):
    sq = lambda i, dx=0.0, dy=0.0, w=40.0, h=40.0: box(far(i) + dx, dy, w, h)
    parcels = [(i, str(i), "1", f"{i}/1", 1600.0, "Residential", sq(i)) for i in range(1, 13)]
    drone = [
        ("same", "1/1", "", 1600.0, sq(1)),
        ("neighbour", "2/1", "", 1600.0, sq(2, 40.0)),
        ("reshaped", "3/1", "", 1600.0, sq(3, -60.0, 15.0, 160.0, 10.0)),
        ("elsewhere", "4/1", "", 1600.0, box(far(4) + 500, 0, 40, 40)),
        ("spike", "5/1", "", 1600.0, pts((far(5), 0), (far(5) + 40, 0), (far(5) + 40, 40), (far(5) + 21, 40), (far(5) + 20, 70), (far(5) + 19, 40), (far(5), 40))),
        ("contradicted", "6/1", "", 1600.0, sq(6)),
        ("wrong_number", "99/9", "", 1600.0, sq(7)),
        ("shifted", "8/1", "", 1600.0, sq(8, 1.0, 1.0)),
        ("rank_a", "9/1", "", 1600.0, sq(9, 2.0)),
        ("rank_b", "9/1", "", 1600.0, sq(9, 0.5)),
        ("huge", "10/1", "", 6400.0, sq(10, -20.0, -20.0, 80.0, 80.0)),
        ("split", "11/1", "Plot Division", 800.0, sq(11, 0.0, 0.0, 20.0, 40.0)),
        ("tie_b", "12/1", "", 1600.0, sq(12)),
        ("tie_a", "12/1", "", 1600.0, sq(12)),
    ]
    gnss = [("6/1", k, far(6) + 200.0, 200.0 + k) for k in range(4)] + [("1/1", k, x, y) for k, (x, y) in enumerate([(far(1), 0.0), (far(1) + 40, 0.0), (far(1) + 40, 40.0), (far(1), 40.0)])]
    p, d, g = spark.createDataFrame(parcels, PARCEL), spark.createDataFrame(drone, DRONE), spark.createDataFrame(gnss, GNSS)
    scored = M.evidence(p, d, g).persist()
    return {r.parcel_id: r for r in M.best_matches(p, scored).collect()}, scored


def test_cases(best):
    b, _ = best
    assert b[1].feature_id == "same" and b[1].score == 100.0 and b[1].gnss_state == "HIGH" and b[1].flags == []
    assert b[2].feature_id is None
    assert b[3].centroid_dist < 1 and "max_deviation" in b[3].flags
    assert b[4].feature_id is None
    assert "max_deviation" in b[5].flags and b[5].score == 65.0
    assert b[6].flags == ["gnss"] and b[6].gnss_pct == 0.0
    assert b[7].attribute_pct == 20.0 and b[7].score == 88.0
    assert b[8].flags == [] and b[8].score > 90
    assert b[9].feature_id == "rank_b"
    assert "area_difference" in b[10].flags
    assert b[12].feature_id == "tie_a"


def test_ranks_are_dense_and_audited(best):
    _, scored = best
    ranks = M.ranked(scored).groupBy("parcel_id").agg(F.max("rank").alias("m"), F.count("*").alias("n"), F.countDistinct("rank").alias("d")).collect()
    assert all(r.m == r.n == r.d for r in ranks)


def test_published_pair_style_profile():
    import numpy as np

    a = np.array([(0, 0), (40, 0), (40, 40), (0, 40)], float)
    mean, median, p90, p95, p99, most, far_, conform = M.deviation_profile(a, a + [0.5, 0.0])
    assert most == far_ == 0.5 and median <= p90 <= p95 <= p99 <= most and 0 < mean < 0.5 and conform == 100.0


def test_conflict_rules_in_order(spark):
    names = "legacy double, revenue double, drone double, has boolean, ftype string, iou double, cen double, score double, status string, ruse string, use string"
    rows = [
        (1487.0, 1520.0, 1541.0, True, "", 95.0, 99.0, 95.0, "Active", "R", "R"), (1500.0, None, None, False, "", 0.0, 0.0, 0.0, None, None, "R"), (1500.0, 1500.0, 1500.0, True, "Plot Division", 10.0, 10.0, 50.0, "Active", "R", "R"),
        (1500.0, 1500.0, 1500.0, True, "Consolidated Compound", 99.0, 99.0, 99.0, "Active", "R", "R"), (1500.0, 1500.0, 1510.0, True, "", 55.0, 99.0, 60.0, "Active", "R", "R"), (1500.0, 1800.0, 1500.0, True, "", 99.0, 99.0, 99.0, "Active", "R", "R"),
        (1500.0, 1500.0, 1500.0, True, "", 99.0, 99.0, 99.0, "Active", "C", "R"), (1500.0, 1500.0, 1500.0, True, "", 99.0, 99.0, 99.0, "Disputed", "R", "R"), (1500.0, 1500.0, 1500.0, True, "", 99.0, 99.0, 99.0, "Active", "R", "R"),
    ]
    c = F.col
    df = spark.createDataFrame(rows, names).select(S.conflict(c("legacy"), c("revenue"), c("drone"), c("has"), c("ftype"), c("iou"), c("cen"), c("score"), c("status"), c("ruse"), c("use")).alias("x"))
    assert [r.x.type if r.x else None for r in df.collect()] == ["Geometry", "Missing", "Split", "Merge", "Geometry", "Area", "Attribute", "Attribute", None]


def test_recommended_area_and_gates(spark):
    df = spark.createDataFrame([(None, 1541.0, 1520.0, 1487.0), (None, None, None, 10.0)], "g double, d double, r double, l double")
    got = df.select(S.recommended_area({"gnss": F.col("g"), "drone": F.col("d"), "revenue": F.col("r"), "legacy": F.col("l")}).alias("a")).collect()
    assert [r.a for r in got] == [round((1541 * 0.9 + 1520 * 0.78 + 1487 * 0.65) / 2.33, 1), 10.0]
    df = spark.createDataFrame([(0.1, 30.0, 0.4), (0.9, 1.0, 0.9)], "i double, h double, a double").select(S.gates(F.col("i"), F.col("h"), F.col("a")).alias("g"))
    assert [r.g for r in df.collect()] == [["iou", "hausdorff", "area"], []]


def test_survey_numbers(spark):
    rows = [(" 0104 / 03 ", "104/3", "104/3", 100.0), ("000", "7", "0", 20.0), ("12/1", "12/2", "12/1", 80.0), (None, "1", "", 50.0)]
    df = spark.createDataFrame([(a, b) for a, b, *_ in rows], "a string, b string").select(X.normalized_survey(F.col("a")).alias("n"), X.survey_similarity(F.col("a"), F.col("b")).alias("s"))
    assert [(r.n, r.s) for r in df.collect()] == [(n, s) for *_, n, s in rows]


def test_numbered_ids(spark):
    df = R.numbered(spark.range(3).withColumnRenamed("id", "k"), "C", "cid", "k")
    assert [r.cid for r in df.orderBy("k").collect()] == ["C-001", "C-002", "C-003"]


def test_numbered_over_many_ranges(spark):
    df = spark.range(2500).select((F.pmod(F.xxhash64("id"), F.lit(10**9))).alias("k"), "id")
    got = R.numbered(df, "C", "cid", "k", "id").orderBy("k", "id").collect()
    assert [r.cid for r in got] == [f"C-{n:03d}" for n in range(1, 2501)]


def test_profiles_of_a_batch_are_those_of_each_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    rings = []
    for _ in range(60):
        n = int(rng.integers(3, 12))
        turn = np.sort(rng.uniform(0, 2 * np.pi, n))
        rings.append(np.column_stack([np.cos(turn), np.sin(turn)]) * rng.uniform(0.5, 60) + rng.uniform(0, 50, 2))
    rings[7] = np.repeat(rings[7][:1], 3, axis=0)  # no length at all
    a, b = rings[:30], rings[30:]
    got = M.deviation_profiles(K.Rings([r.ravel() for r in a]), K.Rings([r.ravel() for r in b]))

    def boundary(r):
        ahead = np.roll(r, -1, axis=0) - r
        size = np.hypot(*ahead.T)
        gap = max(0.2, min(0.5, size.sum() / 20)) if size.sum() else 1.0
        out, ends = [], np.cumsum(size)
        for k in range(max(20, int(size.sum() / gap)) if size.sum() else 0):
            e = min(int(np.searchsorted(ends, k * gap, "right")), len(r) - 1)
            out.append(r[e] + ahead[e] * ((k * gap - (ends[e] - size[e])) / size[e] if size[e] else 0.0))
        return np.array(out).reshape(-1, 2)

    def from_ring(points, r):
        ahead = np.roll(r, -1, axis=0) - r
        best = np.full(len(points), np.inf)
        for u, d in zip(r, ahead, strict=True):
            t = np.clip((points - u) @ d / ((d @ d) or 1.0), 0, 1)
            best = np.minimum(best, np.hypot(*(points - u - t[:, None] * d).T))
        return best

    for x, y, row in zip(a, b, got, strict=True):
        d = np.sort(np.concatenate([from_ring(boundary(x), y), from_ring(boundary(y), x)]))
        far_ = max(from_ring(x, y).max(), from_ring(y, x).max())
        want = [d.mean(), *(d[int(q * (len(d) - 1))] for q in (0.5, 0.9, 0.95, 0.99)), d[-1], far_]
        assert np.allclose(row[:7], want, atol=0.0051) and abs(row[7] - (d <= S.TOLERANCE).mean() * 100) <= 0.0501


def test_points_fall_back_to_the_bare_number(spark):
    parcels = spark.createDataFrame([(1, "7", "7/1"), (2, "7", "7/2"), (3, "8", "8/1")], "parcel_id long, survey_no string, full_survey string")
    points = [("7/1", k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4)])] + [("7", k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (3, 0), (0, 3)])] + [("9", 0, 1.0, 1.0)]
    gnss = spark.createDataFrame(points, GNSS).repartition(5)
    got = M.with_gnss_key(parcels, gnss).join(M.gnss_areas(gnss), "gnss_key", "left").collect()
    assert {(r.parcel_id, r.gnss_key, r.n_points, r.gnss_area) for r in got} == {(1, "7/1", 4, 16.0), (2, "7", 3, 4.5), (3, "8", None, None)}
    assert {r.gnss_key: r.gnss_area for r in M.gnss_areas(gnss).collect()}["9"] is None


def test_area_of_a_number_over_many_ranges(spark):
    import math

    n = 3000
    rows = [("1", k, 100 * math.cos(2 * math.pi * k / n), 100 * math.sin(2 * math.pi * k / n)) for k in range(n)] + [("2", k, float(k), float(k)) for k in range(3)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else one range holds all
    try:
        got = {r.gnss_key: (r.n_points, r.gnss_area) for r in M.gnss_areas(spark.createDataFrame(rows, GNSS)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == {"1": (n, round(n / 2 * 100**2 * math.sin(2 * math.pi / n), 1)), "2": (3, 0.0)}


def test_nearest_features_at_any_distance(spark):
    parcels = spark.createDataFrame([(k, box(0.0, 5000.0 * k, 10, 10)) for k in range(6)], f"parcel_id long, ring {RING}")
    lines = spark.createDataFrame([(1, pts((100, 0), (100, 10))), (2, pts((0, 30), (0, 40)))], f"feature_id long, line {RING}")
    got = {r.parcel_id: round(r.distance, 3) for r in L.nearest_features(parcels, lines).collect()}
    assert got == {0: 20.0, **{k: 5000.0 * k - 40.0 for k in range(1, 6)}}
    assert L.nearest_features(parcels, lines.limit(0)).count() == 0
