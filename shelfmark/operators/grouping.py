"""Per-group picks that survive hot groups.

Both helpers filter a ``row_number``, which Spark runs as a group limit on each
input partition before the shuffle: a group with a third of all rows sends at
most ``k`` rows per partition to its final task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(table: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1 in column ``rank``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per(table: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group.  NULL keys form groups of their own."""
    return top_per(table, keys, order, 1, "_rank").drop("_rank")
