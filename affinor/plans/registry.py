"""Query registry: a Spark callable and, where SQL can say it, an independent oracle text."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AREA: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query taking fixture tables; `sql` may use any view of fixture_sql.VIEWS."""
    def add(fn):
        from affinor.plans.fixtures import Fixtures

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))
        run.__name__ = name
        QUERIES[name] = run
        AREA[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def with_views(sql: str, views: dict[str, str]) -> str:
    """Put the definitions of the views a text uses in front of it, inner ones first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name in views and name not in order:
                visit(views[name])
                if name not in order:
                    order.append(name)
    visit(sql)
    if not order:
        return sql
    head = "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in order)
    body = sql.strip()
    return head + (",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body)
