"""Review pages: extraction, de-duplication over rounds, stall rule, attachment to products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import urls
from shelfmark.functions.text import extract, lookup
from shelfmark.operators.grouping import first_per, top_per
from shelfmark.operators.hits import extract_hits
from shelfmark.rules import REVIEW_RULES, Rule
from shelfmark.schemas import PRODUCT, REVIEW, REVIEW_ITEM

STALL_ROUNDS = 3
# Vote counts written as words.
_NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
# The sentence around a vote count, a rating's wording, and what stands before a date.
_HELPFUL = r"\s*(?:person|people)\s*found\s+this\s+helpful"
_STARS = r"(?U)([\d.]+)\s*out\s*of\s*5"
_BEFORE_DATE = r"(?idU)^.*?\b(?:on|am)\b\s*"


def helpful_votes(text: Column) -> Column:
    """"3 people found this helpful" to 3, number words up to ten included; else NULL."""
    number = extract(text, rf"(?iU)(\d+){_HELPFUL}", 1).try_cast("int")
    word = F.lower(extract(text, rf"(?iU)({'|'.join(_NUMBER_WORDS)}){_HELPFUL}", 1))
    return F.coalesce(number, lookup(dict(zip(_NUMBER_WORDS, range(1, 11))), word))


def review_rating(text: Column) -> Column:
    return F.coalesce(extract(text, _STARS, 1), text)


def review_date(text: Column) -> Column:
    """Without the sentence up to the first word "on" or "am"."""
    return F.regexp_replace(text, _BEFORE_DATE, "")


def extract_reviews(pages: DataFrame, *, rules: Sequence[Rule] = REVIEW_RULES, keep: Sequence[str] = ()) -> DataFrame:
    """Review PAGE (one row per url and load round) to REVIEW and the columns ``keep``; no shuffle."""
    hits = extract_hits(pages, rules, keep=["url", "round", *keep])

    def text_of(field: str) -> Column:
        return F.get(F.col("r")[field], F.lit(0))["text"]

    columns = {
        "asin": urls.page_asin(F.col("url")),
        "text": text_of("body"),
        "rating": review_rating(text_of("stars")),
        "date": review_date(text_of("date")),
        "verified": F.coalesce(F.contains(text_of("badge"), F.lit("Verified Purchase")), F.lit(False)),
        "helpful_votes": helpful_votes(text_of("votes")),
    }
    return (
        hits.select("url", "round", *keep, F.posexplode("review").alias("pos", "r"))
        .withColumns(columns)
        .select(*REVIEW.fieldNames(), *keep)
    )


def top_reviews(reviews: DataFrame, max_reviews: int) -> DataFrame:
    """The reviews a reader collects per URL, numbered in ``review_rank``.

    Rounds count from 1; a round that is missing brought nothing new.  A review is
    new the first time its (text, date) shows; reading ends at ``max_reviews``, or
    after three rounds in a row without a new one.  Only the first ``max_reviews``
    new reviews of a URL can matter, so the stall rule looks at no more than those.
    """
    order = [F.col("round"), F.col("pos")]
    new = first_per(
        reviews.withColumn("_date", F.coalesce("date", F.lit(""))), ["url", "text", "_date"], order
    ).drop("_date")
    ranked = top_per(new, ["url"], order, max_reviews, "review_rank")
    read = Window.partitionBy("url").orderBy(*order)
    return (
        ranked.withColumn("_gap", F.col("round") - F.lag("round", 1, 0).over(read))
        .withColumn("_stalled", F.max(F.col("_gap") > STALL_ROUNDS).over(read))
        .where(~F.col("_stalled"))
        .drop("_gap", "_stalled")
    )


def attach_reviews(products: DataFrame, reviews: DataFrame, max_reviews: int) -> DataFrame:
    """Products with their reviews as an array; a product without any keeps an empty one.

    Review pages have URLs of their own, so products and reviews meet by item id; by URL where there is none, and
    for products without an ``asin`` column.
    """
    if max_reviews <= 0:
        return products
    item = F.struct("review_rank", *REVIEW_ITEM.fieldNames())
    by_item = "asin" in products.columns
    keyed = reviews.withColumn("url", F.coalesce("asin", "url")) if by_item else reviews
    lists = (
        top_reviews(keyed, max_reviews)
        .groupBy(F.col("url").alias("_key"))
        .agg(F.sort_array(F.collect_list(item)).alias("_items"))
        .select(
            "_key",
            F.transform("_items", lambda i: F.struct(*(i[name].alias(name) for name in REVIEW_ITEM.fieldNames()))).alias("_items"),
        )
    )
    empty = F.array().cast(PRODUCT["reviews"].dataType)
    keyed = products.withColumn("_key", F.coalesce("asin", "url") if by_item else F.col("url"))
    return keyed.join(lists, "_key", "left").withColumn("reviews", F.coalesce("_items", empty)).drop("_items", "_key")
