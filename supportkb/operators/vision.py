"""Image description jobs: building, sharding, resuming and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["source", "image_rel"]


def distinct_media(cell_images: DataFrame) -> DataFrame:
    """One row per media file."""
    return cell_images.filter("media_file <> ''").select("media_file").distinct()


def vision_jobs(manual_pairs: DataFrame, cell_images: DataFrame, contains: str = "") -> DataFrame:
    """Jobs: page images of manuals and distinct workbook media, optionally only those whose name
    holds a substring."""
    manual = manual_pairs.filter("image_rel <> ''").select(F.lit("manual").alias("source"), "image_rel")
    sheet = distinct_media(cell_images).select(F.lit("xlsx").alias("source"),
                                               F.concat(F.lit("xlsx:"), "media_file").alias("image_rel"))
    jobs = manual.unionByName(sheet)
    return jobs.filter(F.contains("image_rel", F.lit(contains))) if contains else jobs


def shard_jobs(jobs: DataFrame, n: int, partitions: int | None = None) -> DataFrame:
    """Adds shard: the job's position in (source, image) order modulo n.

    The order is global, so the position is built from a range partitioning: rows are ranked inside
    their range and the counts of earlier ranges are added."""
    from pyspark.sql import Window as W

    from supportkb.sizing import cut_lineage

    spark = jobs.sparkSession
    parts = partitions or spark.sparkContext.defaultParallelism
    # The ranges are sampled, so they are written out once before they are read twice.
    ranged = cut_lineage(jobs.repartitionByRange(parts, *KEY).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(  # one row per range
        W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*KEY))
    return (ranged.withColumn("_i", inside).join(F.broadcast(before), "_part")
            .withColumn("shard", F.pmod(F.col("_before") + F.col("_i") - 1, F.lit(n)).cast("int"))
            .select(*jobs.columns, "shard"))


def pending_jobs(jobs: DataFrame, done: DataFrame, retry_failed: bool = False, force: bool = False,
                 limit: int | None = None) -> DataFrame:
    """Jobs not yet attempted (any status); when retrying, those whose last rows failed; when forced, all."""
    status = F.coalesce(F.trim("status"), F.lit(""))
    tried = done.filter(~F.startswith(status, F.lit("fail")) if retry_failed else status != "").select(*KEY).distinct()
    out = jobs if force else jobs.join(tried, KEY, "left_anti")
    return out.orderBy(*KEY).limit(limit) if limit else out


def pending_repairs(todo: DataFrame, repairs: DataFrame, include_empty: bool = False, force: bool = False,
                    limit: int | None = None) -> DataFrame:
    """Weak pages without a successful repair; almost empty pages only on request."""
    out = todo if include_empty else todo.filter(~F.startswith("reason", F.lit("empty_ocr")))
    if not force:
        ok = repairs.filter(F.startswith(F.coalesce("status", F.lit("")), F.lit("ok"))).select("base", "page_seq").distinct()
        out = out.join(ok, ["base", "page_seq"], "left_anti")
    return out.orderBy("base", "page_seq").limit(limit) if limit else out


def merge_shards_first_wins(rows: DataFrame, priority: list[str]) -> DataFrame:
    """First row per (source, image) by priority: the base file, then shards by name. An aggregate,
    so copies combine before the shuffle."""
    best = F.min_by(F.struct(*rows.columns), F.struct(*priority))
    return rows.groupBy(*KEY).agg(best.alias("b")).select("b.*")


def _failed() -> Column:
    return F.startswith(F.coalesce("status", F.lit("")), F.lit("fail"))


def vision_summary(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("total_unique"), F.count_if(F.col("status") == "ok").alias("ok"),
                      F.count_if(_failed()).alias("fail"),
                      F.count_if(F.trim(F.coalesce("status", F.lit(""))) == "").alias("unattempted"))


def repair_summary(repairs: DataFrame) -> DataFrame:
    return repairs.agg(F.count_if(F.col("status") == "ok").alias("repaired_pages"), F.count_if(_failed()).alias("failed"))


def status_filter(rows: DataFrame) -> DataFrame:
    """Only rows that succeeded."""
    return rows.filter("status = 'ok'")


def cleaned_counts(rows: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return rows.agg(F.count_if(ok).alias("total_ok"), F.count_if(~ok).alias("failed_rows_cleaned"))
