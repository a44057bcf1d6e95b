"""Run requests: defaults, clamps, mode, and the seeds they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import urls
from shelfmark.functions.text import filled, strip

# Name -> default, minimum, maximum.
LIMITS = {
    "max_results": (5, 1, 200),
    "max_pages": (3, 1, 20),
    "max_reviews": (10, 0, 200),
    "retries": (2, 1, 10),
    "timeout": (15000, 3000, 120000),
    "wait": (0, 0, 30000),
}
DEFAULT_ZIP = "90035"
RETRIES, MAX_RETRIES = LIMITS["retries"][0], LIMITS["retries"][2]
NOTHING_TO_DO = "a request must give a search term or product URLs"


def limit(value: Column, name: str) -> Column:
    """Whole number between the bounds; the default for NULL and for text that is no number."""
    default, low, high = LIMITS[name]
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(default)))).cast("int")


def _number(raw: DataFrame, name: str) -> Column:
    """As a whole number; text of any number of digits counts, beyond 64 bits as the largest or least."""
    if not isinstance(raw.schema[name].dataType, T.StringType):
        return F.col(name).try_cast("bigint")
    text = strip(F.col(name))
    beyond = F.when(text.startswith("-"), -(2**62)).otherwise(2**62)
    return F.coalesce(text.try_cast("bigint"), F.when(text.rlike(r"^[+-]?[0-9]{19,}\z"), beyond))


def normalize_requests(raw: DataFrame) -> DataFrame:
    """Raw requests to REQUEST rows plus ``mode``, ``fresh_run`` and ``reject``.

    Columns may be missing or NULL.  Numbers may come as text; product URLs as an
    array or as text with one URL per line.  A search term wins over URLs; a row
    with neither has mode ``search`` and a reject reason.
    """
    have = set(raw.columns)

    def text(name: str, default: str | None) -> Column:
        given = F.col(name).cast("string") if name in have else F.lit(None).cast("string")
        return given if default is None else F.coalesce(given, F.lit(default))

    if "product_urls" not in have:
        listed = F.lit(None).cast("array<string>")
    elif isinstance(raw.schema["product_urls"].dataType, T.ArrayType):
        listed = F.filter(
            F.transform("product_urls", lambda u: filled(strip(u.cast("string")))), lambda u: u.isNotNull()
        )
    else:
        listed = urls.split_urls(text("product_urls", None))
    domain = text("domain", urls.DEFAULT_DOMAIN)
    term, some_urls = F.col("search_term"), F.coalesce(F.size("product_urls") > 0, F.lit(False))
    return raw.select(
        *(F.col(name) for name in ("request_id",) if name in have),
        filled(strip(text("search_term", None))).alias("search_term"),
        listed.alias("product_urls"),
        F.when(domain.isin(urls.DOMAINS), domain).otherwise(F.lit(urls.DEFAULT_DOMAIN)).alias("domain"),
        *(limit(_number(raw, name) if name in have else F.lit(None), name).alias(name) for name in LIMITS),
        text("zip", DEFAULT_ZIP).alias("zip"),
        (F.coalesce(F.col("fresh_run").cast("boolean"), F.lit(False)) if "fresh_run" in have else F.lit(False)).alias(
            "fresh_run"
        ),
    ).withColumns(
        {
            "mode": F.when(term.isNull() & some_urls, F.lit("urls")).otherwise(F.lit("search")),
            "reject": F.when(term.isNull() & ~some_urls, F.lit(NOTHING_TO_DO)),
        }
    )


def url_seeds(requests: DataFrame) -> DataFrame:
    """One row per product URL of the URL-mode requests: cleaned, with the domain of the list.

    The list's first known domain replaces a default domain.
    """
    domain = F.when(
        F.col("domain") == urls.DEFAULT_DOMAIN, F.coalesce(urls.first_known_domain(F.col("product_urls")), F.col("domain"))
    ).otherwise(F.col("domain"))
    keep = [name for name in ("request_id", "retries", "max_reviews", "fresh_run") if name in requests.columns]
    return (
        requests.where("mode = 'urls' AND reject IS NULL")
        .withColumn("domain", domain)
        .select(*keep, "domain", F.posexplode("product_urls").alias("pos", "given_url"))
        .withColumn("url", urls.clean_url(F.col("given_url")))
    )


def search_seeds(requests: DataFrame) -> DataFrame:
    """One row per result page that a search request may walk, with its URL."""
    page = F.col("page_num")
    keep = [name for name in ("request_id", "max_results", "max_pages") if name in requests.columns]
    return (
        requests.where("mode = 'search' AND reject IS NULL")
        .select(
            *keep,
            "domain",
            F.col("search_term").alias("query"),
            F.explode(F.sequence(F.lit(1), F.col("max_pages"))).alias("page_num"),
        )
        .withColumn("search_url", urls.search_url(F.col("domain"), F.col("query"), F.when(page > 1, page)))
    )
