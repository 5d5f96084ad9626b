"""Registry of named queries: a Spark job and, where one exists, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfstar.plans.ctes import with_tables
from shelfstar.plans.report import Report
from shelfstar.star import Star

JOBS: dict[str, Callable[[Star], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _add(name: str, run: Callable[[Star], DataFrame], check: str | None) -> None:
    assert name not in QUERIES, name
    JOBS[name] = run
    QUERIES[name] = lambda spark, sf_dir: run(Star(spark, sf_dir))
    if check:
        CHECKS[name] = with_tables(check)


def query(name: str, check: str | None = None):
    """Register ``fn(star) -> DataFrame`` under ``name``."""
    def wrap(fn: Callable[[Star], DataFrame]):
        _add(name, fn, check)
        return fn
    return wrap


def report(name: str, r: Report) -> Report:
    _add(name, r.frame, r.sql())
    return r
