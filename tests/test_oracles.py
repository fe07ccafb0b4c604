"""Every registered query with SQL gives the SQL's rows; the others run, and are held against plain searches in test_plain.py."""

import pytest

from cuelattice.queries import all_oracles, all_queries
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_matches_sql(spark, name):
    same(spark, all_queries()[name], all_oracles()[name], SF)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_runs(spark, name):
    df = all_queries()[name](spark, SF)
    assert [tuple(r) for r in df.collect()] is not None and len(set(df.columns)) == len(df.columns)
