"""Size checks before a broadcast, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_CHARS = 32 * 1024 * 1024


def measure(df: DataFrame, *extra) -> dict:
    """Row count and total characters of all columns, plus any extra aggregates, in one job."""
    width = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns
                 if df.schema[c].dataType.typeName() not in ("array", "struct", "map")), F.lit(0))
    nested = [c for c in df.columns if df.schema[c].dataType.typeName() in ("array", "struct", "map")]
    for c in nested:
        width = width + F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("chars"),
                 *extra).first()
    return row.asDict()


def is_small(size: dict, max_rows: int = MAX_BROADCAST_ROWS, max_chars: int = MAX_BROADCAST_CHARS) -> bool:
    return size["rows"] <= max_rows and size["chars"] <= max_chars


def broadcast_if_small(df: DataFrame, **limits) -> DataFrame:
    """Hint a broadcast only when the measured size allows it; otherwise leave a shuffle join."""
    return F.broadcast(df) if is_small(measure(df), **limits) else df


def broadcast_if(df: DataFrame, proven_small: bool) -> DataFrame:
    """Hint a broadcast where the caller has proven a bound, e.g. from the size of the query table."""
    return F.broadcast(df) if proven_small else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Only a local master, where all tasks see one
    disk, gets a folder of its own when none is named; anywhere else a missing one is an error."""
    current = spark.sparkContext.getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or current
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("name a folder all executors share in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="supportkb-cp-")
    if not current:
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder so that later branches read it instead of redoing it;
    the scan keeps column pruning and its size, which join choices rest on."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")            # the shuffle files behind it go with the write
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_at = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Remove the files behind a ``cut_lineage`` that nothing will read again."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._cut_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
