"""All registered queries of the core, with their SQL where SQL can express them.

Each module of this package holds a dict QUERIES of name to (query, SQL or None).
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@cache
def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        for name, pair in importlib.import_module(f"{__name__}.{module}").QUERIES.items():
            if name in found:
                raise ValueError(f"two queries are named {name}")
            found[name] = pair
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["p1_found"](spark, sf_dir)
