"""Page tables that lie by URL, so that wanted pages meet their seeds without moving.

A table written in hash buckets of its URL is read with that layout: a join on the URL moves the seeds, a few bytes
each, to the buckets, and never the pages. That holds for any number of seeds, where a broadcast filter
(:mod:`operators.membership`) lets ever more pages through once there are more keys than its bits serve.

Take at least as many buckets as ``spark.sql.shuffle.partitions``: with fewer, Spark moves the pages to have more tasks.
Spark keeps the layout in the catalog. ``write_bucketed`` registers the table there; where the catalog forgets it (one
of the session's own), ``register_bucketed`` names the same folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def write_bucketed(rows: DataFrame, table: str, path: str, *, buckets: int, key: str = "url") -> None:
    """Writes ``rows`` to ``path`` in ``buckets`` hash buckets of ``key``, one file each, as ``table`` of the catalog."""
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)


def register_bucketed(spark: SparkSession, table: str, path: str, schema: T.StructType, *, buckets: int, key: str = "url") -> DataFrame:
    """The table of a folder that :func:`write_bucketed` wrote with these buckets, in a catalog that does not know it."""
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(table)} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(table)
