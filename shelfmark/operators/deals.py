"""Original price, deal badge, coupon and discount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import prices
from shelfmark.functions.text import extract, filled, first_of, first_text
from shelfmark.rules import DEAL_WORDS, WAS_WORDS


def original_price(ranked_hits: Column, was_hits: Column) -> Column:
    """List-price elements, then the price inside a "was" / "list price" sentence."""

    def in_sentence(hit: Column) -> Column:
        named = F.lower(hit["text"]).rlike(WAS_WORDS)
        return F.when(named, extract(hit["text"], prices.PRICE_IN_TEXT))

    return F.coalesce(first_text(ranked_hits), first_of(was_hits, in_sentence))


def deal_badge(deal_hits: Column, badge_hits: Column) -> Column:
    keyed = first_of(badge_hits, lambda hit: F.when(F.lower(hit["text"]).rlike(DEAL_WORDS), filled(hit["text"])))
    return F.coalesce(first_text(deal_hits), keyed)


def deal_fields() -> list[Column]:
    """Columns from deal hits; the discount follows in :func:`with_discount`."""
    badge = deal_badge(F.col("deal"), F.col("badge"))
    coupon = F.size("coupon") > 0
    return [
        original_price(F.col("original_price"), F.col("was_price")).alias("original_price"),
        F.coalesce(badge, F.when(coupon, F.lit("Coupon"))).alias("deal_type"),
        (badge.isNotNull() | coupon).alias("has_deal"),
    ]


def with_discount(table: DataFrame, price: str, original: str = "original_price") -> DataFrame:
    """Savings, percentage and sale flag from two price texts; a deal flag stays set."""
    current, before = prices.amount(F.col(price)), prices.amount(F.col(original))
    deal = F.col("has_deal") if "has_deal" in table.columns else F.lit(False)
    return (
        table.withColumns({"current_amount": current, "original_amount": before})
        .withColumns(
            {
                "saved_amount": prices.savings(F.col("current_amount"), F.col("original_amount")),
                "saved_percent": prices.discount_percent(F.col("current_amount"), F.col("original_amount")),
            }
        )
        .withColumns(
            {
                "savings_amount": F.concat(prices.currency_symbol(F.col(price)), F.col("saved_amount").cast("string")),
                "discount_percentage": F.concat(F.col("saved_percent").cast("string"), F.lit("%")),
                "is_on_sale": deal | F.col("saved_amount").isNotNull(),
            }
        )
    )


def price_deals(hits: DataFrame, *, price: Column, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The price record of each hits row: current and original price, deal, discount."""
    fields = hits.select(*keep, price.alias("current_price"), *deal_fields())
    return with_discount(fields, "current_price").select(
        *keep, "current_price", "original_price", "discount_percentage", "deal_type", "is_on_sale", "savings_amount"
    )
