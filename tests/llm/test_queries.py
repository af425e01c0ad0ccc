"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from check_queries import canonical, duck

from quillspark.llm import queries

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    result = duck(SF_DIR).execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, result.fetchall())


def test_one_query_per_operator():
    import __spark_entry__ as entry

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
