"""A stored snapshot table that captures are merged into.

Rows lie in hash buckets of their key. A merge reads and rewrites only the buckets that its rows fall into, so a key
has one row, its newest, after any number of merges, and there is nothing to compact. Every write is a new
generation in a folder of its own; a manifest, written last and as one file, says which generation of each bucket
counts. A reader sees the table as of the newest manifest; a merge that fails leaves it as it was, and its folders
are named by no manifest. One writer at a time.

Number of buckets: a fixed parameter of a table. A bucket is what a merge rewrites, so take as many as leave each at
some hundred megabytes; the manifest has a row for each, and that much (never page text or keys) comes to the driver.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from shelfmark.functions.urls import url_key
from shelfmark.operators.grouping import first_per
from shelfmark.operators.snapshots import latest
from shelfmark.schemas import SNAPSHOT

BUCKETS = 64
_MANIFEST = "version bigint, buckets int, bucket int, generation string"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """The store at ``path``; ``buckets`` counts when it is new, a stored one keeps its own."""
        self.spark, self.path, self.buckets = spark, path, buckets
        self.buckets = self._manifest()[1]

    def _manifest(self) -> tuple[int, int, dict[int, str]]:
        """Version, number of buckets, and the generation of every bucket that has rows."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
            version = rows.agg(F.max("version")).first()[0]
        except AnalysisException:  # no such folder: a new store
            version = None
        if version is None:
            return 0, self.buckets, {}
        now = rows.where(F.col("version") == version).collect()  # at most a row for each bucket
        return version, now[0]["buckets"], {row["bucket"]: row["generation"] for row in now if row["generation"] is not None}

    def _commit(self, version: int, generations: dict[int, str]) -> None:
        rows = [(version, self.buckets, b, g) for b, g in sorted(generations.items())] or [(version, self.buckets, None, None)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _folders(self, generations: dict[int, str], wanted: set[int] | None = None) -> list[str]:
        return [f"{self.path}/data/bucket={b}/generation={g}" for b, g in sorted(generations.items()) if wanted is None or b in wanted]

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SNAPSHOT)
        return self.spark.read.schema(SNAPSHOT).parquet(*folders)

    def _touched(self, keys: DataFrame) -> set[int]:
        found = keys.select(bucket_of(F.col("url_key"), self.buckets).alias("b")).distinct().collect()
        return {row["b"] for row in found}

    def _rewrite(self, rows: DataFrame, touched: set[int], version: int, generations: dict[int, str]) -> None:
        """``rows`` become all that the touched buckets hold."""
        generation = uuid4().hex
        placed = rows.withColumns({"bucket": bucket_of(F.col("url_key"), self.buckets), "generation": F.lit(generation)})
        placed.write.mode("append").partitionBy("bucket", "generation").parquet(f"{self.path}/data")
        try:
            schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("generation", T.StringType())])
            written = self.spark.read.schema(schema).parquet(f"{self.path}/data").where(F.col("generation") == generation).select("bucket").distinct()
            filled = {row["bucket"] for row in written.collect()}  # partition values alone
        except AnalysisException:
            filled = set()
        kept = {b: g for b, g in generations.items() if b not in touched}
        self._commit(version + 1, kept | dict.fromkeys(filled, generation))

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """SNAPSHOT rows, one a key. With ``keys`` (url_key), only of the buckets that these fall into, which other keys share."""
        _, _, generations = self._manifest()
        return self._rows(self._folders(generations, None if keys is None else self._touched(keys)))

    def merge(self, captures: DataFrame) -> None:
        """Adds SNAPSHOT rows; of a key's rows the newest stays, as :func:`operators.snapshots.latest` chooses.

        Rows without a key are left out. No new rows, no new generation.
        """
        version, _, generations = self._manifest()
        new = latest(captures.select(*SNAPSHOT.fieldNames()).where("url_key IS NOT NULL"))
        touched = self._touched(captures.where("url_key IS NOT NULL"))
        if not touched:
            return
        both = self._rows(self._folders(generations, touched)).unionByName(new)
        # At most two rows a key are left; they meet in their bucket, where they are written.
        dealt = both.withColumn("bucket", bucket_of(F.col("url_key"), self.buckets)).repartition(len(touched), "bucket")
        order = [F.col("cached_at").desc_nulls_last(), F.xxhash64("html")]
        self._rewrite(first_per(dealt, ["bucket", "url_key"], order).drop("bucket"), touched, version, generations)

    def invalidate(self, urls: DataFrame) -> None:
        """Removes the listed URLs; buckets without any of them are not read."""
        version, _, generations = self._manifest()
        gone = urls.where("url IS NOT NULL").select(url_key(F.col("url")).alias("url_key")).distinct()
        touched = self._touched(gone) & set(generations)
        if touched:
            rows = self._rows(self._folders(generations, touched))
            self._rewrite(rows.join(gone, "url_key", "left_anti").select(*SNAPSHOT.fieldNames()), touched, version, generations)

    def clear(self) -> None:
        """An empty table; nothing is read."""
        self._commit(self._manifest()[0] + 1, {})
