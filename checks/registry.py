"""Collects the queries and their SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import VIEWS
from tapeworks.plans.workers import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals; adding 0 turns a negative zero into zero."""
    return df.select(
        *[
            (F.round(F.col(f.name), 6) + F.lit(0.0)).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def with_views(sql: str) -> str:
    """Prefix the views a statement uses, directly or through other views."""
    needed: set[str] = set()
    queue = [sql]
    while queue:
        text = queue.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                queue.append(VIEWS[name])
    ctes = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed]
    return ",\n".join(ctes)


def query(name: str, sql: str | None = None, doubles: str = "", recursive: str = ""):
    """Register a query; ``doubles`` names the result columns rounded in the SQL.

    ``recursive`` is one more common table the statement needs, written out with its name.
    """

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            views = with_views(sql + " " + recursive)
            parts = [p for p in (views, recursive, f"result AS ({sql})") if p]
            replaced = ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in doubles.split())
            star = f"* REPLACE ({replaced})" if replaced else "*"
            SQL[name] = "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT {star} FROM result"
        return fn

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster shares."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
