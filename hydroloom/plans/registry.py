"""Registry of queries: each pairs a DataFrame builder with an oracle in ANSI SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hydroloom.plans.views import VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with_views(sql: str) -> str:
    """Prefix `sql` with the canonical views it names, in definition order."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"\b[a-z_][a-z0-9_]*\b", pending.pop()))
        for name in VIEW_SQL:
            if name in words and name not in needed:
                needed.add(name)
                pending.append(VIEW_SQL[name])
    ctes = [f"{name} AS ({VIEW_SQL[name]})" for name in VIEW_SQL if name in needed]
    body = sql.strip()
    own = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if own:
        ctes_text = ",\n".join(ctes)
        rest = body[own.end():]
        return f"WITH RECURSIVE {ctes_text}{',' if ctes else ''}\n{rest}"
    return (f"WITH {', '.join(ctes)}\n" if ctes else "") + body


def query(name: str, sql: str | None = None):
    """Register `build(views) -> DataFrame` under `name`, with its oracle when SQL can say it."""

    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = _with_views(sql)
        return build

    return register
