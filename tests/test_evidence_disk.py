"""What courtyard_evidence writes on the way: no shape of a parcel in pairs, one of a candidate only where survey points may be inside."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parcelfusion.functions.numbers import rounded
from parcelfusion.operators import matching as M
from parcelfusion.plans import shape_queries as Q
from parcelfusion.plans.fixtures import derived

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def test_pairs_are_written_without_shapes(spark, monkeypatch):
    written, stored = {}, M.stored
    monkeypatch.setattr(M, "stored", lambda df, name: written.setdefault(name, stored(df, name)))
    found = Q.courtyard_evidence(spark, DATA)
    pairs = written["candidate-pairs"]
    assert not {"flat", "ring", "shape", "d_ring", "d_shape", "line", "x1", "d_x1"} & set(pairs.columns)
    assert pairs.where("not met and (d_flat is not null or d_box is not null)").isEmpty()
    monkeypatch.undo()
    p, d = Q._holed_sides(spark, DATA)
    whole = M.evidence(p, d, derived(spark, DATA, "gnss")).select("parcel_id", "feature_id", rounded(F.col("iou"), 4).alias("iou"), "area_pct", "centroid_dist", "gnss_pct")
    rows = lambda df: sorted(tuple(r) for r in df.withColumn("gnss_pct", F.coalesce("gnss_pct", F.lit(-1.0))).collect())
    assert rows(found) == rows(whole) and pairs.count() == len(rows(whole)) > 0
