"""Stored page captures: newest version, validity, lookup, invalidation, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.urls import url_key
from shelfmark.operators.grouping import first_per
from shelfmark.operators.membership import possible
from shelfmark.schemas import SNAPSHOT_VERSION


def is_expired(cached_at: Column, ttl_seconds: Column, as_of: Column) -> Column:
    """Older than its time to live; exactly as old is still valid."""
    return F.unix_micros(as_of) - F.unix_micros(cached_at) > ttl_seconds.cast("bigint") * 1_000_000


def with_status(snapshots: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``status``: ``hit`` or the reason for a miss.  An empty page is a hit.

    ``meta_ok`` (from the directory scan) is NULL without a meta file and false for a
    broken one; stored tables have no such column and are whole by construction.
    """
    meta = F.col("meta_ok") if "meta_ok" in snapshots.columns else F.lit(True)
    status = (
        F.when(F.col("html").isNull(), "no_html")
        .when(meta.isNull(), "no_meta")
        .when(~meta | F.col("cached_at").isNull() | F.col("ttl_seconds").isNull(), "bad_meta")
        .when(~F.col("version").eqNullSafe(SNAPSHOT_VERSION), "version")
        .when(is_expired(F.col("cached_at"), F.col("ttl_seconds"), as_of), "expired")
        .otherwise("hit")
    )
    return snapshots.withColumn("status", status)


def latest(snapshots: DataFrame) -> DataFrame:
    """The last write per key.  Two writes at one instant: the page's hash decides, so always the same one."""
    tie = F.xxhash64("html") if "html" in snapshots.columns else F.col("tie")
    return first_per(snapshots, ["url_key"], [F.col("cached_at").desc_nulls_last(), tie])


def newest_only(snapshots: DataFrame, keys: DataFrame) -> DataFrame:
    """Of captures that ``keys`` (url_key) ask for, about the newest ones, without moving any page text.

    The newest write per key is found on narrow rows, reduced before they are shuffled; a Bloom filter of
    those writes then picks the captures where they are read.  A few others pass, so
    :func:`latest` must follow; the newest of a wanted key always passes.
    """
    tied = snapshots.withColumn("tie", F.xxhash64("html"))
    # The largest time, then the least tie; a NULL time is the oldest.
    last = F.max(F.struct(F.col("cached_at").alias("at"), F.bitwise_not("tie").alias("tie")))
    chosen = tied.groupBy("url_key").agg(last.alias("last")).join(keys.distinct(), "url_key", "left_semi")
    wanted = chosen.select(F.xxhash64("url_key", F.col("last.at"), F.bitwise_not(F.col("last.tie"))))
    return possible(tied, F.xxhash64("url_key", "cached_at", "tie"), wanted).drop("tie")


def lookup(seeds: DataFrame, snapshots: DataFrame, as_of: Column) -> DataFrame:
    """Every seed with ``status`` (``absent`` if never stored) and, for a hit, page and time.

    The newest captures of wanted keys are chosen on narrow rows; only their page texts are moved.
    """
    wanted = seeds.select(url_key(F.col("url")).alias("url_key")).distinct()
    stored = with_status(latest(newest_only(snapshots, wanted)), as_of)
    hit = F.col("status") == "hit"
    found = stored.select(
        "url_key", "status", F.when(hit, F.col("html")).alias("html"), F.when(hit, F.col("cached_at")).alias("cached_at")
    )
    return (
        seeds.withColumn("url_key", url_key(F.col("url")))
        .join(found, "url_key", "left")
        .withColumn("status", F.coalesce("status", F.lit("absent")))
    )


def invalidate(snapshots: DataFrame, urls: DataFrame) -> DataFrame:
    """Snapshots without every version of the listed URLs."""
    gone = urls.select(url_key(F.col("url")).alias("url_key"))
    return snapshots.join(gone, "url_key", "left_anti")


def clear(snapshots: DataFrame) -> DataFrame:
    """No snapshot at all, in the same shape."""
    return snapshots.where(F.lit(False))


def stats(snapshots: DataFrame, as_of: Column, lookups: DataFrame | None = None) -> DataFrame:
    """One row: entries, bytes and expired entries, plus hits and misses of a lookup log.

    Entries are page halves: a page without a meta file still counts, never as expired.
    """
    # The page text is measured before the newest version is picked, so that only its size is shuffled.
    narrow = snapshots.select(
        "url_key", "cached_at", "ttl_seconds", F.octet_length("html").alias("bytes"), F.xxhash64("html").alias("tie")
    )
    current = latest(narrow).where(F.col("bytes").isNotNull())
    expired = F.coalesce(is_expired(F.col("cached_at"), F.col("ttl_seconds"), as_of), F.lit(False))
    stored = current.agg(
        F.count("*").alias("total_entries"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.count_if(expired).alias("expired_entries"),
    )
    if lookups is None:
        return stored.withColumns({"hits": F.lit(0), "misses": F.lit(0), "hit_rate": F.lit(0.0)})
    log = lookups.agg(
        F.count_if(F.col("status") == "hit").alias("hits"), F.count_if(F.col("status") != "hit").alias("misses")
    )
    # Two single-row aggregates, put together by one more over both.
    both = stored.unionByName(log, allowMissingColumns=True).agg(
        *(F.max(name).alias(name) for name in ("total_entries", "total_bytes", "expired_entries", "hits", "misses"))
    )
    return both.withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))
