"""Every registered raster query against its DuckDB form on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tessera.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "embeddings", "events", "lineitem", "nation", "orders", "part", "region", "supplier")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        # nulls first: DuckDB's integers with nulls compare as NA, which any() would pass over
        here = a[c].notna().to_numpy()
        assert (here == b[c].notna().to_numpy()).all(), c
        assert all(x == y for x, y in zip(a[c][here], b[c][here], strict=True)), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    if name == "utm_round_trip":
        assert all(r["lon_back"] and r["lat_back"] for r in rows)
    if name == "tiff_roundtrip":
        assert all(r["same"] for r in rows)


def test_no_theta_join(spark):
    """Tiles and windows meet by key."""
    for name in ("extract_bilinear", "sample_band", "window_join"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
