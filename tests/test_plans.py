"""Every query of the core against its SQL, on the smallest tables; the others run and keep their schema."""

import pytest

from loci.plans import registry


# Names that share one SQL are one query under several inventory names; it is compared once.
ONCE = {sql: name for name, sql in sorted(registry.ORACLES.items(), reverse=True)}


@pytest.mark.parametrize("name", sorted(ONCE.values()))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, small):
    df = registry.QUERIES[name](spark, small)
    assert df.columns and df.collect() is not None
