"""String leaves of JSON documents of any depth."""

from __future__ import annotations

import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

from quillspark.functions.chunks import in_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def string_leaves(document: str | None) -> list[str]:
    """Every string value of one document; names are not values."""
    pending, leaves = [json.loads(document)] if document else [], []
    while pending:
        value = pending.pop()
        if isinstance(value, str):
            leaves.append(value)
        elif isinstance(value, dict):
            pending.extend(value.values())
        elif isinstance(value, list):
            pending.extend(value)
    return leaves


@F.arrow_udf(T.ArrayType(T.StringType()))
def json_leaves(document: pa.Array) -> pa.Array:
    return in_slices(document, string_leaves, pa.list_(pa.string()))
