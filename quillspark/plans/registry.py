"""One entry per registered query: how Spark builds it and the SQL it is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.model import MODEL_SQL

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    covers: tuple[str, ...]


class Registry:
    def __init__(self) -> None:
        self.entries: dict[str, Query] = {}
        self.shared_sql: dict[str, str] = dict(MODEL_SQL)

    def define(self, name: str, sql: str) -> None:
        """A named SQL relation that oracles may use."""
        self.shared_sql[name] = sql

    def query(self, name: str, covers: str, oracle: str | None = None):
        def register(build: Builder) -> Builder:
            if name in self.entries:
                raise ValueError(f"query {name} is registered twice")
            self.entries[name] = Query(name, build, oracle, tuple(covers.split()))
            return build

        return register

    def oracle_sql(self, name: str) -> str | None:
        """The oracle with the shared relations it mentions put in front of it."""
        body = self.entries[name].oracle
        if body is None:
            return None
        needed: list[str] = []
        seen: set[str] = set()

        def visit(text: str) -> None:
            for relation, sql in self.shared_sql.items():
                if relation not in seen and re.search(rf"\b{relation}\b", text):
                    seen.add(relation)
                    visit(sql)
                    needed.append(relation)

        visit(body)
        if not needed:
            return body
        parts = ",\n".join(f"{r} AS ({self.shared_sql[r]})" for r in needed)
        body = body.strip()
        if body.upper().startswith("WITH RECURSIVE"):
            return f"WITH RECURSIVE {parts},\n{body[len('WITH RECURSIVE'):]}"
        if body.upper().startswith("WITH"):
            return f"WITH RECURSIVE {parts},\n{body[len('WITH'):]}"
        return f"WITH RECURSIVE {parts}\n{body}"


REGISTRY = Registry()
