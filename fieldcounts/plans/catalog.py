"""Registry of the bound queries: one per operator of SURVEY §2.

Every entry pairs a Spark plan over the driver tables (whole tables, whole
texts) with the DuckDB SQL that computes the same rows, under the same
column names.  Queries without a SQL twin are checked by tests instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def r6(c) -> F.Column:
    """Round a derived double for hashing (the SQL side uses round_even 6)."""
    return F.bround(c, 6)


def load_all() -> dict[str, Query]:
    # importing the modules fills the registry
    from . import queries_core, queries_reshape, queries_quality, queries_surveys, queries_text  # noqa: F401
    return REGISTRY
