"""Every radar query against its SQL."""

from __future__ import annotations

import pytest

from skyshear.plans import registry
from tests.conftest import SF


def plain(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted(tuple(repr(round(r[i], 9) + 0.0 if isinstance(r[i], float) else r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    relation = duck.sql(registry.ORACLES[name])
    assert sorted(relation.columns) == names
    assert plain([tuple(r) for r in df.collect()], df.columns, names) == plain(relation.fetchall(), list(relation.columns), names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
