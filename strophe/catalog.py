"""All registered queries: name -> builder, and name -> SQL where SQL can express the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of queries; each has QUERIES and SQL.
MODULES = tuple(f"strophe.queries.{m}" for m in ("intervals", "text", "lines", "sections", "signal", "timeline", "lookup", "stages", "extras"))


def collect() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    q, s = {}, {}
    for name in MODULES:
        m = importlib.import_module(name)
        q.update(m.QUERIES)
        s.update(m.SQL)
    return q, s
