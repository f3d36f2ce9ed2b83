"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import glob
import math
import os

import pytest

from sparkloom.plans import blocks_catalog, catalog, detect_catalog, discovery_catalog, fleet_catalog, merging_catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(frame):
    missing = lambda x: x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT")
    shown = lambda x: "null" if missing(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


assert fleet_catalog.pick and discovery_catalog.query and blocks_catalog.query and detect_catalog.query and merging_catalog.query


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE:
        want = duck.execute(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
