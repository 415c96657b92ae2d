"""Registered queries, each with the SQL an independent engine checks it by."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from embedlake.plans.tables import Tables
from embedlake.session import tune

Plan = Callable[[Tables], DataFrame]

_plans: dict[str, Plan] = {}
_sql: dict[str, str] = {}

TOPICS = ["evaluation", "ingest", "training", "registry", "tasks", "monitoring", "streams"]


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name."""

    def register(plan: Plan) -> Plan:
        _plans[plan.__name__] = plan
        if sql is not None:
            _sql[plan.__name__] = sql
        return plan

    return register


def _load() -> None:
    for topic in TOPICS:
        importlib.import_module(f"embedlake.plans.{topic}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def runner(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: plan(Tables(tune(spark), folder))

    return {name: runner(plan) for name, plan in _plans.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
