"""Exact duplicates with a heavy-hitter split.

Every row gets the SHA-256 of its whole text. A Misra-Gries summary of ``counters`` digests per task, summed over the
tasks, holds every digest of more than 2.5 rows in ``counters`` and estimates at most ``counters`` of them at one row
in ``counters`` or more: these are the heavy ones. Their exact sizes and winners are counted over all rows
(partial sums per task), and that table, of at most ``counters`` rows, is broadcast, so copies of heavy texts are
decided where they are read. All other digests are shuffled once and decided in a window over the digest; none of
them has more than 2.5 rows in ``counters``. Whether a digest counts as heavy changes the route, never the result.

Defined cases: a null text is an empty text, and all empty texts are copies of each other; a null id is smaller than
any other; of rows that share text and id exactly one stays; ``keep_id`` is null where all ids of a group are; long texts are
hashed whole where they are read and only their digest moves; an empty table gives no row; other columns don't matter."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from supportkb.llm import common

COUNTERS = 1024


def merge_counts(summary: Counter, more: Counter, counters: int) -> Counter:
    """A Misra-Gries summary with the counts of ``more`` added: beyond ``counters`` keys the largest count that has to
    go is taken from all, so no key loses more than one count in ``counters`` + 1 of what was added altogether."""
    summary.update(more)
    if len(summary) > counters:
        loss = sorted(summary.values(), reverse=True)[counters]
        summary = Counter({k: n - loss for k, n in summary.items() if n > loss})
    return summary


def heavy_digests(rows: DataFrame, n_rows: int, counters: int = COUNTERS) -> DataFrame:
    """(digest) of the heavy ones of ``rows`` (digest): at most ``counters`` rows."""
    def run(batches):
        summary, seen = Counter(), 0
        for batch in batches:
            seen += batch.num_rows
            summary = merge_counts(summary, Counter(batch.column(0).to_pylist()), counters)
        # what is under half a row in ``counters`` of this task is no help to a heavy digest
        held = [(k, n) for k, n in summary.items() if 2 * counters * n >= seen]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.binary()), pa.array([n for _, n in held], pa.int64())],
                                             ["digest", "n"])
    return (rows.select("digest").mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
            .filter(F.col("n") * counters >= n_rows).select("digest"))


def digests(docs: DataFrame, text: str = "text", order: str = "doc_id", normalise=None) -> DataFrame:
    """(id, row, digest) of every row, written; ``normalise`` maps the text column before it is hashed."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = normalise(whole) if normalise else whole
    seen = Observation()
    out = docs.select(F.col(order).cast("long").alias("id"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    out = common.written(out.withColumn("row", F.monotonically_increasing_id()).observe(seen, F.count(F.lit(1)).alias("n")), "digests")
    out._rows = seen.get["n"]
    return out


def copy_groups(docs: DataFrame, text: str = "text", order: str = "doc_id", normalise=None, counters: int = COUNTERS) -> DataFrame:
    """(id, digest, keep_id, group_size, same_id, kept) of every row; of equal texts the largest ``order`` stays. ``same_id`` counts
    the rows of the group that share the id that stays."""
    rows = digests(docs, text, order, normalise)
    winner = F.max(F.struct("id", "row"))
    heavy = F.broadcast(heavy_digests(rows, rows._rows, counters))                     # at most ``counters`` rows
    verified = (rows.join(heavy, "digest").groupBy("digest").agg(winner.alias("best"), F.count(F.lit(1)).alias("group_size")))
    verified = common.written(verified, "heavy")
    same = (rows.join(F.broadcast(verified), "digest").filter(F.col("id").eqNullSafe(F.col("best.id")))
            .groupBy("digest").agg(F.count(F.lit(1)).alias("same_id")))
    verified = F.broadcast(common.written(verified.join(F.broadcast(same), "digest"), "winners"))
    frequent = rows.join(verified, "digest")
    rest = rows.join(verified.select("digest"), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.withColumn("best", winner.over(group)).withColumn("group_size", F.count(F.lit(1)).over(group))
    rest = rest.withColumn("same_id", F.count_if(F.col("id").eqNullSafe(F.col("best.id"))).over(group))
    columns = ["id", "digest", F.col("best.id").alias("keep_id"), "group_size", "same_id",
               (F.col("row") == F.col("best.row")).alias("kept")]
    return frequent.select(*columns).unionByName(rest.select(*columns))


def deduplicated(docs: DataFrame, text: str = "text", order: str = "doc_id", normalise=None, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each text. Only rows that share both text and id with the
    one that stays are grouped by their columns."""
    kept = copy_groups(docs, text, order, normalise, counters).filter("kept")
    kept = kept.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("same_id").alias("_same"))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = F.unhex(F.sha2(normalise(whole) if normalise else whole, 256))
    found = docs.select(F.struct("*").alias("doc"), F.col(order).cast("long").alias("id"), whole.alias("digest"))
    found = found.join(kept, found["digest"].eqNullSafe(kept["_digest"]) & found["id"].eqNullSafe(kept["_id"]))
    several = found.filter("_same > 1").groupBy("_digest").agg(F.first("doc").alias("doc"))
    return found.filter("_same = 1").select("doc.*").unionByName(several.select("doc.*"))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    return copy_groups(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                                    F.lower(F.hex("digest")).alias("text_sha256"))
