"""Spark against DuckDB on every registered query with a twin that needs nothing but the rest of the library."""

import glob
import math
import os

import duckdb
import pytest

from pagewright.plans import catalog

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


#: Queries over images have no SQL form; the kernels are tested against plain versions.
IMAGES = {"image_decode", "edge_features", "skew", "stroke_width", "components", "grid_distribution", "brisque", "seals", "tables", "barcode_peaks"}


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLE) | IMAGES and not IMAGES & set(catalog.ORACLE)


@pytest.mark.parametrize("name", sorted(IMAGES))
def test_image_query(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    suppliers = duckdb.sql(f"select s_suppkey from '{SF}/supplier.parquet'").fetchall()
    assert sorted(r["origin"] for r in rows) == sorted(k for (k,) in suppliers)
    for r in rows:
        given = [r[c] is not None for c in r.asDict() if c != "origin"]
        assert all(given) if r["origin"] % 17 != 16 else not any(given)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    found = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == order
    want = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
