"""All registered queries against their SQL on the smallest tables.

What many queries start from (the planned cases, the evaluated search, the event pipeline) is
built once for all of them.
"""

from __future__ import annotations

import functools
import os

import pytest
from check_queries import compare, duck

from quillspark.plans import load_all, retrieval, review, streams
from quillspark.session import materialize

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
NAMES = list(load_all().entries)


@pytest.fixture(scope="module")
def con():
    shared = pytest.MonkeyPatch()
    evaluated = review.evaluated
    shared.setattr(review, "evaluated", functools.cache(lambda spark, sf: materialize(evaluated(spark, sf))))
    for module, name in ((retrieval, "planned_cases"), (retrieval, "cases"), (streams, "run_pipeline"), (streams, "alert_stream")):
        shared.setattr(module, name, functools.cache(getattr(module, name)))
    yield duck(SF_DIR)
    shared.undo()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status, _, _, detail = compare(spark, con, load_all(), name, SF_DIR)
    assert status in ("ok", "rows-only"), detail


def test_entry_point_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
