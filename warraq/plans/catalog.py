"""Registry of the engine's queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shipped
from . import oracles
from . import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: shipped(f) for f in q.ALL}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
