"""Every core query that has SQL gives the same rows; the others run whole."""

import pytest

from matchweft.plans.registry import ORACLES, QUERIES, flagship

from .parity import difference


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), ORACLES[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_flagship(spark, sf):
    assert flagship(spark, sf).count() > 0
