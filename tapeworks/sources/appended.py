"""Prepared bars of a folder of candle files that grows.

A version is written next to the earlier ones, in blocks of time, and becomes visible with
one small manifest that names the version of each block.  Manifests are numbered and
created exclusively, so of two writers one wins and the other starts over from what it
finds; a reader takes the newest manifest that is complete and sees nothing else.

When files are added, only what can change is built anew: per symbol the bars from the
first new candle on, or from its last bar, which may have been partial.  What features look
back on comes from the prepared table itself.  Blocks before that stay as they are.  If a
file is missing or differs, everything is built again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeworks.functions.numeric import floor_div
from tapeworks.operators.bars import DAY
from tapeworks.plans.series import top_k
from tapeworks.sources.manifests import commit, file_system, listed, newest_manifest, numbers, read_manifest, remove
from tapeworks.sources.prepared import cache_key

BLOCK = 7 * DAY
Bars = Callable[[DataFrame], DataFrame]


def source_files(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Size and time of every data file below ``path``."""
    fs, p = file_system(spark, path)
    found, files = {}, fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found[f.getPath().toString()] = [f.getLen(), f.getModificationTime()]
    return found


def read_version(spark: SparkSession, root: str, manifest: dict, since: int | None = None) -> DataFrame:
    """The rows of a manifest, of the blocks from number ``since`` on."""
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    paths = [f"{root}/data/{v}/_block={b}" for b, v in manifest["blocks"].items() if since is None or int(b) >= since]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the versions that none of the last ``keep`` complete manifests names; no writer may be at work."""
    folder = f"{root}/manifests"
    complete = [m for n in numbers(spark, folder) if (m := read_manifest(spark, folder, n)) is not None]
    used = {v for m in complete[:keep] for v in (*m["blocks"].values(), m["version"])}
    gone = [f"{root}/{part}/{v}" for part in ("data", "ends") for v in listed(spark, f"{root}/{part}") if v not in used]
    for path in gone:
        remove(spark, path)
    return gone


def appended(
    spark: SparkSession, source: str, root: str, params: dict, bars: Bars, features: Bars, halo: int,
    start: Callable[[Column], Column], key: str = "symbol", order: str = "bucket", time: str = "open_time", block: int = BLOCK,
) -> DataFrame:
    """The prepared table of the files below ``source``, brought up to date first.

    ``bars`` makes bars of candles, ``features`` adds columns that look back over at most
    ``halo`` bars, and ``start`` gives the bar of a candle's time.
    """
    root = f"{root}/{cache_key(params)}"
    while True:
        number, known = newest_manifest(spark, f"{root}/manifests")
        files = source_files(spark, source)
        if known and known["files"] == files:
            return read_version(spark, root, known)
        grown = known and all(files.get(f) == v for f, v in known["files"].items())
        version = uuid.uuid4().hex
        if grown:
            made, first = _tail(spark, source, root, known, sorted(set(files) - set(known["files"])), bars, features, halo, start, key, order, time, block)
        else:
            made, first = features(bars(spark.read.parquet(source))), 0
        rows = made.withColumn("_block", floor_div(F.col(order), block))
        rows.repartitionByRange("_block", key, order).sortWithinPartitions("_block", key, order).write.partitionBy("_block").parquet(f"{root}/data/{version}")
        written = {n.split("=")[1]: version for n in listed(spark, f"{root}/data/{version}") if n.startswith("_block=")}
        ends, kept, schema = _ends(spark, root, version, made.schema, key, order), {}, made.schema.json()
        if grown:
            earlier = spark.read.parquet(f"{root}/ends/{known['version']}")
            ends = earlier.unionByName(ends).groupBy(key).agg(F.max("_last").alias("_last"))
            kept, schema = {b: v for b, v in known["blocks"].items() if int(b) < first}, known["schema"]
        ends.write.parquet(f"{root}/ends/{version}")
        manifest = {"files": files, "schema": schema, "version": version, "blocks": {**kept, **written}}
        if commit(spark, f"{root}/manifests", number + 1, manifest):
            return read_version(spark, root, manifest)


def _ends(spark: SparkSession, root: str, version: str, schema: StructType, key: str, order: str) -> DataFrame:
    """Last bar of each symbol in a version's own rows."""
    return spark.read.schema(schema).parquet(f"{root}/data/{version}").groupBy(key).agg(F.max(order).alias("_last"))


def _tail(spark, source, root, known, fresh, bars, features, halo, start, key, order, time, block) -> tuple[DataFrame, int]:
    """All rows of the blocks that change: rebuilt from each symbol's cut on, as they were before it."""
    every = spark.read.parquet(source)
    added = spark.read.schema(every.schema).parquet(*fresh)
    last = spark.read.parquet(f"{root}/ends/{known['version']}")
    begun = added.groupBy(key).agg(start(F.min(time)).alias("_begun"))
    cut = begun.join(last, key, "left").select(key, F.least("_begun", "_last").alias("_cut"))
    low = cut.agg(F.min("_cut")).first()[0]
    if low is None:  # the new files are empty
        low = last.agg(F.max("_last")).first()[0]
    first = low // block
    cached = read_version(spark, root, known)
    names = cached.columns
    candles = every.where(F.col(time) >= low).join(cut, key).where(F.col(time) >= F.col("_cut")).drop("_cut")
    built = bars(candles)
    back = cached.select(*built.columns).join(cut, key).where(F.col(order) < F.col("_cut")).drop("_cut")
    before = top_k(back, [key], [F.col(order).desc()], halo, [order])
    renewed = features(before.unionByName(built)).join(cut, key).where(F.col(order) >= F.col("_cut")).select(*names)
    old = read_version(spark, root, known, first).where(F.col(order) >= first * block).join(cut, key, "left")
    stay = old.where(F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))).select(*names)
    return renewed.unionByName(stay), first
