"""Every registered query against its oracle, and that those without one run."""

import pytest

from feedloom.plans import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLE[name], sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE.keys()))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
