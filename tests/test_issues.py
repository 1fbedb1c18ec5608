"""Validation issues of parcels whose rings are computed, not read."""

from collections import Counter

from pyspark.sql import functions as F

from parcelfusion.functions import geometry as G
from parcelfusion.operators.topology import validation_issues


def test_issues_of_computed_rings(spark):
    k = F.col("parcel_id")
    at = lambda x, y: G.point(F.lit(40.0) * k + x, F.lit(0.0) + y)
    square = F.array(at(0, 0), at(30, 0), at(30, 30), at(0, 30))
    crossed = F.array(at(0, 0), at(30, 30), at(30, 0), at(0, 30))
    thin = F.array(at(0, 0), at(30, 0), at(30, 0.1), at(0, 0.1))
    parcels = spark.range(40).select(F.col("id").alias("parcel_id")).select("parcel_id", F.when(k % 4 == 1, crossed).when(k % 4 == 2, thin).when(k % 8 == 3, F.lit(None)).otherwise(square).alias("ring"))
    overlaps = spark.createDataFrame([(1, 2, 3.0)], "a long, b long, overlap double")
    gnss = spark.createDataFrame([(1, 200.0, 0.0), (2, 20.0, 10.0), (3, None, 1.0)], "point_id long, longitude double, latitude double")
    found = validation_issues(parcels, overlaps, gnss).select("source", "feature_id", "issue").collect()
    assert Counter(r.issue for r in found) == {"Missing Geometry": 5, "Self-Intersection": 10, "Sliver": 10, "Overlap": 1, "GNSS Out Of Range": 2}
    assert {int(r.feature_id) % 4 for r in found if r.issue == "Self-Intersection"} == {1}
    assert {int(r.feature_id) % 4 for r in found if r.issue == "Sliver"} == {2}
