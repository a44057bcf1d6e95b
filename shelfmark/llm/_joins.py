"""A join that Spark can split where one key has very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``, which was grouped by ``keys``.

    Spark would join where the groups already lie, without an exchange of their own, and then adaptive execution
    may not deal a hot key's rows out to several tasks. A hash beside the keys asks for that exchange; groups are few.
    """
    return (
        rows.withColumn("__split_join_key", F.xxhash64(*keys))
        .join(groups.withColumn("__split_join_key", F.xxhash64(*keys)), [*keys, "__split_join_key"], how)
        .drop("__split_join_key")
    )
