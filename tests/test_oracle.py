"""Every query of the library that has SQL gives the same rows."""

import os

import pytest

from frameloom.jobs import catalog_queries, file_queries, layout_queries, pixel_queries
from oracle import SF, same

GROUPS = (catalog_queries, pixel_queries, layout_queries, file_queries)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", [k for g in GROUPS for k in g.ORACLE_SQL])
def test_same_rows(spark, name):
    group = next(g for g in GROUPS if name in g.ORACLE_SQL)
    same(spark, group.QUERIES[name], group.ORACLE_SQL[name])


@pytest.mark.parametrize("name", [k for g in GROUPS for k in g.QUERIES if k not in g.ORACLE_SQL])
def test_rows_without_sql(spark, name):
    group = next(g for g in GROUPS if name in g.QUERIES)
    assert group.QUERIES[name](spark, SF).count() > 0


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
