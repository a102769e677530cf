"""Every registered query against its SQL at the smallest scale."""

import glob

import pytest

import __spark_entry__ as entry_module
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/events.parquet"), reason="no test tables")
#: Queries of the corpus operators are tested in their own folder.
OWN = [n for n in entry_module.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql().get(name), SF)
    assert ok, message


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert "severity" in df.columns
