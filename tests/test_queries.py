"""Every registered query against its SQL on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from checks import base
from compare import difference

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, name):
    assert difference(spark, name, base.QUERIES[name], ORACLE[name], SF) is None


def test_every_query_has_sql():
    assert set(base.ORACLE) == set(base.QUERIES)
    assert set(base.QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["bucket", "size"] and df.count() > 0
