"""Numbered versions of a folder: what a reader sees changes in one step, when the next version file appears.

Writers put data into new folders first and name them in ``_versions/<number>.json`` last, by a rename that never replaces
a file. A reader takes the greatest number; data no version names is not seen by anyone."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm.org.apache.hadoop.fs.Path


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Committed version numbers, ascending."""
    fs, path = _fs(spark, root)
    folder = path(f"{root}/_versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, root: str, number: int | None = None) -> dict | None:
    """What a version names, the latest by default; None before the first one."""
    if number is None:
        known = numbers(spark, root)
        if not known:
            return None
        number = known[-1]
    fs, path = _fs(spark, root)
    stream = fs.open(path(f"{root}/_versions/{number:012d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Make ``content`` the version ``number``. An error if somebody else has done so."""
    fs, path = _fs(spark, root)
    folder = path(f"{root}/_versions")
    fs.mkdirs(folder)
    target, temporary = path(f"{root}/_versions/{number:012d}.json"), path(f"{root}/_versions/.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(temporary, target):
        fs.delete(temporary, False)
        raise FileExistsError(f"version {number} of {root} exists")
