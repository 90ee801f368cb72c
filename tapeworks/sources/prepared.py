"""Prepared feature tables kept as Parquet under a key made from their parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def cache_key(params: Mapping[str, object]) -> str:
    """Digest of all parameters, the source path among them, in sorted order."""
    return hashlib.sha256(json.dumps(dict(params), sort_keys=True, default=str).encode()).hexdigest()[:32]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def source_version(spark: SparkSession, path: str) -> list[list[object]]:
    """Names, sizes and times of the files below a path, to make part of a key."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append([f.getPath().getName(), f.getLen(), f.getModificationTime()])
    return sorted(found)


def prepared(
    spark: SparkSession, root: str, params: Mapping[str, object], build: Callable[[], DataFrame],
    order: tuple[str, ...] = ("symbol", "bucket"),
) -> DataFrame:
    """The table for ``params``: read if complete, else built, written and read.

    It is read under the schema it was built with: folder names such as ``007`` stay text.

    Rows are range-partitioned by ``order`` before the write, so a symbol of any
    size is spread over tasks, each folder holds few files, and the row-group
    statistics of a file cover a short stretch of time.
    """
    path = f"{root}/{cache_key(params)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        built = build()
        spark.createDataFrame([(built.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-schema")
        rows = built.repartitionByRange(*order).sortWithinPartitions(*order)
        rows.write.mode("overwrite").partitionBy(order[0]).parquet(path)
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}-schema").first()[0]))
    return spark.read.schema(schema).parquet(path).select(*schema.names)
