"""Run registered queries against DuckDB: ``python tests/check_queries.py [sf] [name-part ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    """One form for values of both engines."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, registry, name, sf_dir):
    """(status, spark row count, spark seconds, detail)."""
    started = time.time()
    df = registry.entries[name].build(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    sql = registry.oracle_sql(name)
    if sql is None:
        return "rows-only", len(rows), took, ""
    started = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    left = canonical(df.columns, rows)
    right = canonical(names, result.fetchall())
    oracle_took = time.time() - started
    if left[0] != right[0]:
        return "COLUMNS", len(rows), took, f"{left[0]} vs {right[0]}"
    if left[1] != right[1]:
        diff = next(((a, b) for a, b in zip(left[1], right[1]) if a != b), None)
        return "VALUES", len(rows), took, f"{len(left[1])} vs {len(right[1])} rows; first difference {str(diff)[:600]}"
    return "ok", len(rows), took, f"oracle {oracle_took:.1f}s"


def main() -> int:
    from quillspark.plans import load_all
    from quillspark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("check", 8)
    con = duck(sf_dir)
    registry = load_all()
    bad = 0
    for name in registry.entries:
        if parts and not any(p in name for p in parts):
            continue
        try:
            status, n, took, detail = compare(spark, con, registry, name, sf_dir)
        except Exception as error:  # report and go on
            status, n, took, detail = "ERROR", 0, 0.0, f"{type(error).__name__}: {str(error)[:500]}"
        bad += status in ("ERROR", "COLUMNS", "VALUES")
        print(f"{status:9} {name:44} rows={n:<7} {took:5.1f}s {detail}", flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
