"""URL jobs over any table with a URL column, and the links of generic pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import urls


def canonicalise_urls(
    table: DataFrame,
    column: str = "url",
    *,
    params: Iterable[str] = urls.TRACKING_PARAMS,
    host_pattern: str = "amazon",
) -> DataFrame:
    """Adds the canonical URL, its key, the item id, and the marketplace domain with its locale."""
    url = F.col(column)
    return (
        table.withColumn("canonical_url", urls.clean_url(url, params, host_pattern))
        .withColumns(
            {
                "url_key": urls.url_key(F.col("canonical_url")),
                "asin": urls.url_asin(url),
                "domain": urls.marketplace_domain(url),
            }
        )
        .withColumns(
            {"timezone": urls.domain_timezone(F.col("domain")), "locale": urls.domain_locale(F.col("domain"))}
        )
    )


def pending(seeds: DataFrame, processed: DataFrame | None, *, fresh_run: bool = False) -> DataFrame:
    """Seeds that were not processed before; a fresh run takes them all."""
    if fresh_run or processed is None:
        return seeds
    return seeds.join(processed.select("url"), "url", "left_anti")
