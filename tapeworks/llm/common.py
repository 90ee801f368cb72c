"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of this package, with its SQL where SQL can express it."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def reach(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, wherever the driver was started.

    A cluster needs it installed, or shipped with ``addPyFile``.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster shares: spark.checkpoint.dir, else the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: later steps do not depend on lost executors."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return memory that this process no longer uses to the system: Arrow's pools and the C heap keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` on batches, after which a worker that waits for its next task holds no more than it needs."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
