"""Every query with SQL gives DuckDB's rows and types on the smallest tables."""

import pytest

from svloom.plans import alignment_queries, evidence_queries, scoring_queries, sequence_queries, variant_queries  # noqa: F401
from svloom.plans.registry import ORACLES, QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def shown(row):
    return repr(tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in row))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    relation = duck.sql(ORACLES[name])
    assert columns == sorted(relation.columns)
    kinds = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    assert {c: TYPES[k] for c, k in got.dtypes} == kinds
    expected = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(shown, got.select(columns).collect())) == sorted(map(shown, expected))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_is_repeatable(spark, sf, name):
    rows = sorted(map(str, QUERIES[name](spark, sf).collect()))
    assert rows and rows == sorted(map(str, QUERIES[name](spark, sf).repartition(3).collect()))
