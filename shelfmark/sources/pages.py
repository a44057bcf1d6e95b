"""Readers of captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.urls import url_key
from shelfmark.schemas import PAGE, SNAPSHOT
from shelfmark.sources.directory import is_directory, read_directory, read_pairs

# File name shapes of a snapshot directory (64 hex digits).
_HTML_FILE = r"/([0-9a-f]{64})\.html$"
_META_FILE = r"/([0-9a-f]{64})\.meta\.json$"
_META = "struct<url:string,cached_at:double,ttl_seconds:int,version:string>"
_META_KEYS = ["url", "cached_at", "ttl_seconds", "version"]


def read_pages(spark: SparkSession, path: str, page_kind: str | None = None, *, partitions: int | None = None) -> DataFrame:
    """PAGE table.  A page kind is a filter Spark pushes into the scan (or prunes to a partition).

    Parsing costs far more than reading.  Where few large files would give too few tasks, lower
    ``spark.sql.files.maxPartitionBytes``, or ask for ``partitions``, which deals the rows out by a shuffle.
    """
    pages = spark.read.schema(PAGE).parquet(path)
    pages = pages if page_kind is None else pages.where(F.col("page_kind") == page_kind)
    return pages if partitions is None else pages.repartition(partitions)


def _whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Files as rows.  Spark's file sources skip files of zero bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "modificationTime", F.make_valid_utf8(F.col("content").cast("string")).alias("value"))


def read_page_files(spark: SparkSession, path: str, page_kind: str = "product") -> DataFrame:
    """A directory of HTML files, one page each; the file path stands for the URL."""
    return _whole_files(spark, path, "*").select(
        F.col("path").alias("url"),
        F.col("value").alias("html"),
        F.lit(None).cast("string").alias("rendered_html"),
        F.col("modificationTime").alias("captured_at"),
        F.lit(page_kind).alias("page_kind"),
    )


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).parquet(path)


def scan_snapshot_dir(spark: SparkSession, path: str, *, empty_pages: bool = False) -> DataFrame:
    """A directory of ``<key>.html`` / ``<key>.meta.json`` pairs as SNAPSHOT rows plus ``meta_ok``.

    Both halves of a pair share the key in their file name; either may be missing.
    Meta data must be an object with url, cached_at and ttl_seconds, version
    optional, and nothing else.  Spark's file sources do not show files of zero bytes, so a page of zero bytes is
    a missing one; with ``empty_pages`` a source of its own (:mod:`sources.directory`) reads the directory, to which an
    empty page is a page, for folders that ``pyarrow.fs`` opens.  Without it such folders are listed by a task, any other path by
    the driver, as Spark's file sources do.
    """
    if empty_pages:
        pairs = read_directory(spark, path)
    elif is_directory(path):
        pairs = read_pairs(spark, path)
    else:

        def files(glob: str, shape: str, name: str) -> DataFrame:
            found = _whole_files(spark, path, glob)
            key = F.regexp_extract(F.col("path"), shape, 1)
            return found.select(key.alias("url_key"), F.col("value").alias(name)).where(F.col("url_key") != "")

        pairs = files("*.html", _HTML_FILE, "html").join(files("*.meta.json", _META_FILE, "meta"), "url_key", "full")
    keys = F.json_object_keys("meta")
    allowed = F.array(*map(F.lit, _META_KEYS))
    told = F.from_json("meta", _META)
    ok = (F.size(F.array_except(keys, allowed)) == 0) & told["url"].isNotNull() & told["cached_at"].isNotNull() & told["ttl_seconds"].isNotNull()
    pairs = pairs.withColumns(
        {"told": told, "meta_ok": F.when(F.col("meta").isNotNull(), F.coalesce(ok, F.lit(False))), "has_version": F.array_contains(keys, "version")}
    )
    return pairs.select(
        "url_key",
        F.col("told.url").alias("url"),
        "html",
        F.timestamp_micros((F.col("told.cached_at") * 1_000_000).try_cast("bigint")).alias("cached_at"),
        F.col("told.ttl_seconds").alias("ttl_seconds"),
        F.when(F.col("has_version"), F.col("told.version")).otherwise(F.lit("1")).alias("version"),
        "meta_ok",
    )


def as_snapshots(pages: DataFrame, ttl_seconds: int, version: str = "1") -> DataFrame:
    """Captured pages as SNAPSHOT rows."""
    return pages.select(
        url_key(F.col("url")).alias("url_key"),
        "url",
        "html",
        F.col("captured_at").alias("cached_at"),
        F.lit(ttl_seconds).alias("ttl_seconds"),
        F.lit(version).alias("version"),
    )
