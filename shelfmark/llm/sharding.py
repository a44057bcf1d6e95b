"""Shards by proportional stratified interleaving, with DataFrame functions alone.

The rows of a source are shuffled by a seeded hash of their id and ranked 0, 1, 2 ...; a row's fractional rank is
(rank + 1/2) / rows of its source. Sorted by it (ties: the smaller source first, then by name) all rows form one
line in which every stretch holds the sources in their overall proportions. The line is cut into stretches whose
row counts differ by one at most: the shards.

Nothing is sorted as a whole. The hash range is cut into zones of about ``ZONE_ROWS`` rows, whatever their
sources. Rows are counted by zone and source from ids and sources alone; the sums of the zones before give every zone
its first rank in each source. Then a row, with its text, moves once, to its zone, and gets its rank there. Its
place in the line is arithmetic: of a source of c rows, floor(((2 rank + 1) c + n - 1) / 2n) rows stand before rank
``rank`` of a source of n rows. Places of a zone lie close together, so a zone goes to one or two shards.

Two tables take one task a key: the counts by zone, summed up within a source (a row for each zone, no text), and
the list of sources, numbered within equal sizes. Sources are taken to be far fewer than rows; the sizes
that occur among them become one literal, a number or two a size.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import work_folder

ZONE_ROWS = 1024
SEED = 17


def source_key(source: Column) -> Column:
    """NULL is a source of its own, the first by name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def shuffle_hash(identity: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))).cast("binary"))


def _zone(hashed: Column, zones: int) -> Column:
    top = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint")
    return F.shiftright(top * F.lit(zones).cast("bigint"), 32)


def _rows_before(sizes: dict[int, int]) -> Column:
    """Rows of the line before rank ``sharding_r`` of a source of ``sharding_n`` rows, number ``sharding_nth`` of the sources of this size.

    ``sizes``: how many sources have a size. Decimals, as products of two row counts need not fit 64 bits.
    """
    table = json.dumps([{"c": c, "m": m} for c, m in sorted(sizes.items())])
    odd, twice = "CAST(2 * sharding_r + 1 AS DECIMAL(20,0))", "CAST(2 * sharding_n AS DECIMAL(20,0))"
    before = f"x.m * (({odd} * x.c + sharding_n - 1) div {twice})"
    tied = f"IF(x.c < sharding_n AND ({odd} * x.c - sharding_n) % {twice} = 0, x.m, 0L)"
    return F.expr(f"aggregate(from_json('{table}', 'array<struct<c:decimal(19,0),m:bigint>>'), 0L, (sum, x) -> sum + {before} + {tied}) + sharding_nth")


def placed(docs: DataFrame, shards: int, seed: int = SEED, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """The rows, all columns, with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard) added
    (prefixed ``sharding_`` where such a column exists).

    Every row gets a place, whatever is NULL in it; NULL is a source of its own. Rows that repeat an id are rows of
    their own; rows of one id, and those without one, share a zone, in the order of their other columns; rows equal in all columns
    may change places among each other. Fewer rows than shards leave shards empty. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    shard, slot = (f"sharding_{n}" if n in docs.columns else n for n in ("shard", "slot"))
    folder = work_folder(spark, "sharding")
    total = docs.count()
    zones = max(1, -(-total // ZONE_ROWS))
    hashed = shuffle_hash(F.col(id_column), seed)
    keys = docs.select(_zone(hashed, zones).alias("zone"), source_key(F.col(source_column)).alias("source"))
    keys.groupBy("zone", "source").agg(F.count("*").alias("rows")).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")

    sources = counts.groupBy("source").agg(F.sum("rows").alias("n"))
    sizes = {row["n"]: row["count"] for row in sources.groupBy("n").count().collect()}
    numbered = sources.withColumn("nth", F.row_number().over(Window.partitionBy("n").orderBy("source")).cast("bigint") - 1)
    earlier = Window.partitionBy("source").orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).join(numbered, "source")
    entry = F.struct("source", F.struct("first", "n", "nth").alias("at"))
    by_zone = first.groupBy("zone").agg(F.map_from_entries(F.collect_list(entry)).alias("sharding_starts"))

    rows = docs.withColumns({"sharding_hash": hashed, "sharding_source": source_key(F.col(source_column))})
    rows = rows.withColumn("sharding_zone", _zone(F.col("sharding_hash"), zones)).repartition("sharding_zone")
    rows = rows.join(by_zone.withColumnRenamed("zone", "sharding_zone"), "sharding_zone")
    orderable = [F.col(name) for name, kind in docs.dtypes if not kind.startswith(("map", "variant")) and "map<" not in kind]
    within = Window.partitionBy("sharding_zone", "sharding_source").orderBy("sharding_hash", id_column, *orderable)
    at = F.col("sharding_starts")[F.col("sharding_source")]
    rows = rows.withColumns({"sharding_r": at["first"] + F.row_number().over(within) - 1, "sharding_n": at["n"], "sharding_nth": at["nth"]})
    rows = rows.withColumn("sharding_place", _rows_before(sizes))
    rows = rows.withColumn(shard, F.expr(f"CAST(sharding_place * {shards} div {max(1, total)} AS INT)"))
    start = F.expr(f"(CAST({shard} AS BIGINT) * {total} + {shards - 1}) div {shards}")
    return rows.withColumn(slot, F.col("sharding_place") - start).select(*docs.columns, shard, slot)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = SEED, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """Writes a folder for each shard (``shard=0`` ...), files in the order of their slots, and returns them as read back.

    A task writes the rows of its zones, so a run that loses executors writes the same rows again, and Spark's commit
    shows only whole tasks. Columns and cases are those of :func:`placed`.
    """
    rows = placed(docs, shards, seed, id_column, source_column)
    shard, slot = rows.columns[-2:]
    rows.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)
