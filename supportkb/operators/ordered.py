"""Running values along an order, split into blocks so that one huge key is no single task.

``block`` must grow with ``order`` (a day, a range of ordinals). Rows are ordered inside
(keys, block) only; the totals of earlier blocks are carried over by a second, small window over
one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _blocks(df: DataFrame, keys: list[str], block: Column) -> DataFrame:
    return df.withColumn("_block", block)


def running_sums(df: DataFrame, keys: list[str], block: Column, order: list[str], **values: Column) -> DataFrame:
    """Adds one running sum per named value, current row included."""
    out = _blocks(df, keys, block)
    for name, value in values.items():
        out = out.withColumn(f"_v_{name}", value)
    before = (out.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values]))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = before.select(*keys, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}")
                                              for n in values])
    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = out.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_i_{n}") for n in values])
    return (out.join(before, [*keys, "_block"])
            .select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in values]))


def running_last(df: DataFrame, keys: list[str], block: Column, order: list[str], name: str, value: Column,
                 inclusive: bool = True) -> DataFrame:
    """Adds the latest non-NULL value up to the current row (or strictly before it)."""
    out = _blocks(df, keys, block).withColumn("_v", value)
    place = F.struct(*order)
    ends = out.filter(F.col("_v").isNotNull()).groupBy(*keys, "_block").agg(F.max_by("_v", place).alias("_e"))
    every = out.select(*keys, "_block").distinct().join(ends, [*keys, "_block"], "left")
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = every.select(*keys, "_block", F.last("_e", True).over(earlier).alias("_b"))
    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = out.withColumn("_i", F.last("_v", True).over(inside))
    return out.join(before, [*keys, "_block"]).select(*df.columns, F.coalesce("_i", "_b").alias(name))
