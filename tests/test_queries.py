"""Every query of the core with SQL, against it."""

import pytest
from conftest import DATA, same_rows

from claimgraph.plans import registry

#: Queries that may have no rows at the smallest scale.
MAY_BE_EMPTY = {"neighborhood", "subject", "quotes", "residue", "digest_drift", "never_surveyed"}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    n = same_rows(registry.QUERIES[name](spark, str(DATA)), duck, registry.SQL[name])
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_without_sql_runs(spark, name):
    if not DATA.exists():
        pytest.skip("no test data")
    assert registry.QUERIES[name](spark, str(DATA)).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    if not DATA.exists():
        pytest.skip("no test data")
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
