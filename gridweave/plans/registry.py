"""Queries by operator id, each with SQL that another engine can run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridweave.sources.views import Views, rounded, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", digits: int | None = 6, rounds: bool = False):
    """Registers a function of Views as the query of an operator id.

    sql: the same result from another engine; its double columns are named in
    a leading comment ``-- doubles: a b`` and rounded like the query's.
    digits: None where the query rounds by itself, before it copies values to rows.
    rounds: that it does so, to the digits that its SQL is rounded to.
    """

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir)) if digits is None or rounds else rounded(f(Views(spark, sf_dir)), digits)
        if sql is not None:
            found = re.match(r"\s*-- doubles:(.*)\n", sql)
            names = found[1].split() if found else []
            body = with_views(views.split(), sql[found.end() :] if found else sql)
            if names:
                each = ", ".join(f"round({c}::double, {digits}) + 0.0::double as {c}" for c in names)
                body = f"select * replace ({each}) from ({body})"
            ORACLES[name] = body
        return f

    return add
