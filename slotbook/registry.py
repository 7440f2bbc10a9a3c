"""Registered queries: key -> (spark, sf_dir) -> DataFrame, plus DuckDB oracle SQL.

Every query reads the raw test tables of ``sf_dir`` through the domain views of
``slotbook.sources.views`` and runs over whole tables.  The oracle SQL of a key
is plain SQL over the same views (inlined as CTEs by ``with_views``); keys
without oracle SQL are checked on row counts and by unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotbook.oracle_views import with_views
from slotbook.sources.views import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RAW_SQL: dict[str, str] = {}   # oracle SQL before the view CTEs are inlined


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            RAW_SQL[key] = sql
            ORACLE[key] = with_views(sql)
        return fn
    return deco


_CATALOGS: dict[tuple[int, str], Catalog] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of ``sf_dir`` for this session, defined once.

    A catalog holds lazy view definitions over one listing of the table files
    (no data is cached): queries reuse the definitions, and every run still
    scans and computes from the files.  Call ``forget_catalogs()`` after the
    files change.
    """
    key = (id(spark), sf_dir)
    cat = _CATALOGS.get(key)
    if cat is None or cat.spark is not spark:
        cat = _CATALOGS[key] = Catalog(spark, sf_dir)
    return cat


def forget_catalogs() -> None:
    _CATALOGS.clear()


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def all_oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)


def _load() -> None:
    # Importing the modules registers their queries.
    from slotbook import queries  # noqa: F401
