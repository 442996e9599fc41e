"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import pytest

from quarry.plans import catalog
from quarry.plans.verify import compare


@pytest.fixture(scope="module")
def results(spark, sf_small):
    return compare(spark, sf_small, verbose=False)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(results, name):
    r = results[name]
    assert "error" not in r, r.get("error")
    if name in catalog.ORACLES:
        assert r["cols_match"], r.get("cols")
        assert r["spark_rows"] == r["duck_rows"]
        assert r["hash_match"], r.get("diff")


def test_entry_contract(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    df = E.entry(spark)
    assert df.count() > 0
