"""Numbered manifests: small JSON files that make a new version of a table visible.

A manifest is created exclusively, so of two writers with the same number one wins.  A
reader takes the newest one that is complete; what no manifest names does not exist.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no folder."""
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def numbers(spark: SparkSession, folder: str) -> list[str]:
    """Names of the manifests in ``folder``, newest first."""
    return sorted((n for n in listed(spark, folder) if n.isdigit()), reverse=True)


def read_manifest(spark: SparkSession, folder: str, name: str) -> dict | None:
    """Content of a manifest, or None if its writer has not finished, or died."""
    row = spark.read.text(f"{folder}/{name}", wholetext=True).first()
    try:
        return json.loads(row[0])
    except (TypeError, ValueError):
        return None


def newest_manifest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """Highest number in use, and content of the newest complete manifest."""
    names = numbers(spark, folder)
    found = next((m for n in names if (m := read_manifest(spark, folder, n)) is not None), None)
    return int(names[0]) if names else 0, found


def commit(spark: SparkSession, folder: str, number: int, manifest: dict) -> bool:
    """Create manifest ``number``; false if another writer has it."""
    fs, p = file_system(spark, f"{folder}/{number:09d}")
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Exception:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return True
