"""Putting the numbers of several tables into one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*one_row_tables: DataFrame) -> DataFrame:
    """One row with the columns of all the given one-row tables; a union, not a cross join."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_tables)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
