"""Every registered query against its SQL, on the smallest tables."""

import pytest
from helpers import DATA, same

from newsloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    same(spark, duck, catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE.keys()))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
