"""Large text files as many tasks: line numbers and quoted rows without reading a file as one row.

Spark cuts a file into blocks and each line belongs to the block it starts in. What a line needs to know about the lines before
it - how many there are, whether a quote is open - is a running sum: inside its block in order, and over the blocks of a
file from one total per block. No task holds more than a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportkb.functions.text import split_lines
from supportkb.operators.ordered import running_sums
from supportkb.sizing import broadcast_if_small, cut_lineage

BOM = "﻿"


def raw_lines(spark: SparkSession, path: str, pattern: str = "*", keep=None) -> DataFrame:
    """file, block, at, line of all files below ``path`` whose names match ``pattern``, cut at line feeds: ``at`` grows along a block.
    Written once, so ``at`` is the same whenever it is read. ``keep`` filters by the file's path."""
    found = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")))
    found = found if keep is None else found.filter(keep(F.col("file")))
    lines = cut_lineage(found.withColumn("at", F.monotonically_increasing_id()))
    # a byte-order mark is one only at the very start of a file
    first = lines.filter("block = 0").groupBy("file").agg(F.min("at").alias("_first"))
    begins = (F.col("at") == F.col("_first")) & F.startswith("line", F.lit(BOM))
    plain = F.when(begins, F.expr("substring(line, 2)")).otherwise(F.col("line"))
    return lines.join(broadcast_if_small(first), "file", "left").select("file", "block", "at", plain.alias("line"))


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, line_no, line of the non-empty lines; lines end at any Unicode line break and all of them count, from 0."""
    lines = raw_lines(spark, path, pattern)
    parts = lines.withColumn("_parts", split_lines(F.regexp_replace("line", r"\r\z", "")))
    summed = running_sums(parts, ["file"], F.col("block"), ["at"], _upto=F.size("_parts").cast("long"))
    each = summed.select("file", (F.col("_upto") - F.size("_parts")).alias("_before"), F.posexplode("_parts").alias("_i", "line"))
    return each.filter("line <> ''").select("file", (F.col("_before") + F.col("_i")).alias("line_no"), "line")


def quoted_rows(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, row_no, text of the rows of quoted text files: a line feed inside quotes does not end a row. ``row_no`` counts from
    0. A row is as long as its quotes make it."""
    lines = raw_lines(spark, path, pattern)
    quotes = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))).cast("long")
    open_ = running_sums(lines, ["file"], F.col("block"), ["at"], _quotes=quotes)
    starts = open_.withColumn("_starts", F.when((F.col("_quotes") - quotes) % 2 == 0, 1).otherwise(0).cast("long"))
    rows = running_sums(starts, ["file"], F.col("block"), ["at"], _row=F.col("_starts"))
    inside = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"])
    return (rows.groupBy("file", (F.col("_row") - 1).alias("row_no")).agg(F.array_join(inside, "\n").alias("text")))
