"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thicket.plans.standins import STANDINS, Tables, oracle_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(t)``; ``t`` gives the test tables and their stand-ins as attributes."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = key
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = with_standins(oracle)
        return fn

    return register


def with_standins(sql: str) -> str:
    """Put the stand-in tables that ``sql`` names in front of it as common table expressions."""
    sql = sql.strip()
    ctes = oracle_ctes({name for name in STANDINS if re.search(rf"\b{name}\b", sql)})
    if not ctes:
        return sql
    head = "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body})" for name, body in ctes)
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.IGNORECASE)
    return head + (",\n" + sql[own.end():] if own else "\n" + sql)
