"""Every query with SQL, on the smallest tables; the driver does the same on larger ones."""

import pytest
from oracle import differences

from cpgloom.plans import data_problems, queries, report_queries

SF = "/root/testdata/sf0.001"
ALL = data_problems.QUERIES | queries.QUERIES | report_queries.QUERIES
SQL = data_problems.ORACLES | queries.ORACLES | report_queries.ORACLES


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert differences(spark, SF, ALL[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_gives_rows(spark, name):
    assert ALL[name](spark, SF).count() > 0
