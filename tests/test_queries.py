"""Registered queries against their SQL on the smallest tables, and the shape of the contract."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from parcelfusion.plans import registry
from parcelfusion.plans.fixtures import BASE

DATA = "/root/testdata/sf0.001"
QUICK = ["candidate_pairs", "pair_overlap", "revenue_lookup", "gnss_lookup", "parcel_overlaps", "building_reference", "building_audit", "parcel_utilities", "sync_changes", "raster_zonal", "raster_mask", "harmonized_records", "register_fields", "reviewed_conflicts", "geojson_round_trip", "gnss_csv_round_trip", "stream_load", "stream_sync", "change_regions", "utm_round_trip", "plausible_buildings", "filled_ids", "road_inventory", "single_layer", "bisected_boundaries", "header_mapping", "parcel_shapes", "courtyard_overlap", "crossed_rings", "sync_records", "parcel_utilities_edge", "raster_zonal_masked"]

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(row):
    return tuple("" if v is None else str(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    ours = sorted(plain(r) for r in df.select(*names).collect())
    assert ours
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == names
    assert ours == sorted(plain(r) for r in rel.select(*[f'"{n}"' for n in names]).fetchall())


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    assert entry.entry(spark).columns == ["total", "matched", "conflicts", "review"]


def test_candidate_join_is_an_equi_join(spark):
    plan = registry.queries()["candidate_pairs"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
