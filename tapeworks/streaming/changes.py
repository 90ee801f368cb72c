"""A keyed table kept as a log of what each micro-batch changed, with compacted snapshots.

Every micro-batch writes the keys it changes under its own id, so a repeated batch
replaces its own rows.  From time to time the newest rows of all keys are written as a
snapshot up to the last finished batch; a manifest makes it visible, and only then do the
batches and the snapshot it replaces go.  The number of files stays bounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tapeworks.sources.manifests import commit, listed, newest_manifest, numbers, remove

COMPACT_EVERY = 20
BATCH = "batch_id="
Cut = Callable[[DataFrame], DataFrame]


def _logged(spark: SparkSession, root: str, schema: T.StructType) -> tuple[DataFrame, int, list[int], dict | None]:
    """All rows with their batch: of the newest snapshot and of the batches behind it."""
    number, manifest = newest_manifest(spark, f"{root}/_manifests")
    upto = manifest["upto"] if manifest else -1
    found = [int(n.removeprefix(BATCH)) for n in listed(spark, root) if n.startswith(BATCH)]
    fields = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    # Batches that a snapshot holds may still lie there, or come again when the last one is repeated.
    rows = [spark.read.schema(fields).option("basePath", root).parquet(f"{root}/{BATCH}{b}") for b in found if b > upto]
    if manifest:
        rows.insert(0, spark.read.schema(fields).parquet(f"{root}/_snapshots/{manifest['snapshot']}"))
    out = spark.createDataFrame([], fields) if not rows else rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out, number, found, manifest


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    newest = rows.groupBy(keys).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, [*keys, "batch_id"])


def read_changes(spark: SparkSession, root: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The rows of each key's newest batch."""
    rows, *_ = _logged(spark, root, schema)
    return _newest(rows, keys).select(*schema.names)


def compact(spark: SparkSession, root: str, schema: T.StructType, keys: list[str], upto: int, cut: Cut | None = None) -> bool:
    """Write the newest rows of every key, of batches up to ``upto``, as a snapshot; false if another writer was faster.

    ``cut`` leaves out what no reader needs any more.
    """
    rows, number, found, before = _logged(spark, root, schema)
    if before and before["upto"] >= upto:
        return False
    name = f"{upto}-{uuid.uuid4().hex}"
    newest = _newest(rows.where(F.col("batch_id") <= upto), keys)
    (cut(newest) if cut else newest).select(*schema.names, "batch_id").write.parquet(f"{root}/_snapshots/{name}")
    if not commit(spark, f"{root}/_manifests", number + 1, {"upto": upto, "snapshot": name}):
        return False
    # The snapshot just replaced stays for readers that have begun with it.
    kept = {name, before["snapshot"]} if before else {name}
    for b in found:
        if b <= (before["upto"] if before else -1):
            remove(spark, f"{root}/{BATCH}{b}")
    for s in listed(spark, f"{root}/_snapshots"):
        if s not in kept:
            remove(spark, f"{root}/_snapshots/{s}")
    for n in numbers(spark, f"{root}/_manifests")[2:]:
        remove(spark, f"{root}/_manifests/{n}")
    return True


def keep_changes(
    frame: DataFrame, root: str, keys: list[str], compact_every: int = COMPACT_EVERY, cut: Cut | None = None, change: Cut | None = None
) -> DataStreamWriter:
    """Write what each micro-batch changes under its batch id; a repeated batch replaces its own rows.

    Every ``compact_every`` batches the finished ones are compacted by ``keys``.  ``change``
    makes the rows to write, of the same columns, out of those of a micro-batch.
    """
    schema = frame.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{root}/{BATCH}{batch_id}")
        if batch_id and batch_id % compact_every == 0:
            compact(batch.sparkSession, root, schema, keys, batch_id - 1, cut)

    return frame.writeStream.outputMode("update").foreachBatch(write)
