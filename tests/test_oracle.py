"""Each query of the reference's own operators against its SQL."""

import pytest

from ctxcost.plans import catalogue

from .oracle import DATA, same

_SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_equals_its_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    same(catalogue.queries()[name](spark, folder), _SQL[name], folder)


def test_all_have_sql():
    assert catalogue.queries().keys() == _SQL.keys()
