"""Seller name, fulfilment, rating, ships-from and buy-box ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.sellers import is_marketplace_seller, normalize_seller
from shelfmark.functions.text import bind, extract, filled, first_of, strip

# Phrases in the tabular box that mean marketplace fulfilment.
_FULFILMENT = "fulfilled by amazon|ships from amazon|shipped from amazon"
# What stands before a seller's or a place's name, and link texts that are no names.
_SOLD_BY = r"(?idU)^\s*sold\s+by\b\s*:?\s*(.*)$"
_BEFORE_SELLER = r"(?iU)^(?:Visit the|Sold by:?\s*)"
_NO_SELLER = "^(?:see|visit|more)"
_BEFORE_PLACE = r"(?iU)^(?:ships from|ships from:?\s*)"
_NOTED_PLACE = r"(?idU)^.*?Ships from:\s*"
# Stars and counts of a seller's rating.
_STARS = r"(?U)([\d.]+)\s*out\s*of\s*5"
_COUNT = r"(?iU)([\d,]+)\s*(?:ratings?|reviews?)"


def seller_name(ranked_hits: Column, sold_by_nodes: Column) -> Column:
    """Ranked elements without generic link texts, then the element after "Sold by:"."""

    def named(hit: Column) -> Column:
        name = strip(F.regexp_replace(hit["text"], _BEFORE_SELLER, ""))
        usable = (F.char_length(name) > 1) & ~F.lower(name).rlike(_NO_SELLER)
        return F.when(usable, name)

    after_label = first_of(sold_by_nodes, lambda n: F.when(F.char_length(n["next_tight"]) > 1, n["next_tight"]))
    return F.coalesce(first_of(ranked_hits, named), after_label)


def is_fulfilled(box_hits: Column, buybox: Column) -> Column:
    """A phrase in the tabular box, or in a text of the buy box (of the page if there is none)."""
    in_box = F.exists(box_hits, lambda hit: F.lower(hit["text"]).rlike(_FULFILMENT))
    return in_box | (F.size(F.get(buybox, F.lit(0))["fulfilled_note"]) > 0)


def seller_rating(rating_hits: Column, feedback: Column) -> Column:
    """Struct (rating, count).  Later elements overwrite until both are known; a
    feedback table overrides the rating."""

    def step(found: Column, hit: Column) -> Column:
        done = found["rating"].isNotNull() & found["count"].isNotNull()
        stars = extract(hit["text"], _STARS, 1)
        count = F.replace(extract(hit["text"], _COUNT, 1), F.lit(","), F.lit(""))
        return F.when(done, found).otherwise(
            F.struct(
                F.coalesce(stars, found["rating"]).alias("rating"),
                F.coalesce(filled(count), found["count"]).alias("count"),
            )
        )

    none = F.lit(None).cast("string")
    fold = F.aggregate(rating_hits, F.struct(none.alias("rating"), none.alias("count")), step)
    # The element counts even when it is empty or without a number: its text then wins.
    stars = F.get(F.get(feedback, F.lit(0))["stars"], F.lit(0))["text"]
    override = F.coalesce(extract(stars, r"(?U)[\d.]+"), stars)
    return bind(fold, lambda known: F.struct(F.coalesce(override, known["rating"]).alias("rating"), known["count"].alias("count")))


def buybox_sold_by(buybox: Column) -> Column:
    """Seller named by the buy box: inline ("Sold by: X"), in the label's element, or the next link."""
    box = F.get(buybox, F.lit(0))

    def inline(text: Column) -> Column:
        return extract(text, _SOLD_BY, 1)

    labelled = first_of(
        box["sold_by_label"],
        lambda n: F.coalesce(strip(inline(n["parent_spaced"])), filled(n["next_spaced"])),
    )
    return F.coalesce(strip(first_of(box["sold_by_inline"], lambda hit: inline(hit["text"]))), labelled)


def ships_from(ranked_hits: Column, buybox: Column) -> Column:
    """Ranked elements, then a "Ships from:" text of the buy box (of the page if there is none)."""

    def place(hit: Column) -> Column:
        name = strip(F.regexp_replace(hit["text"], _BEFORE_PLACE, ""))
        return F.when(F.char_length(hit["text"]) > 3, filled(name))

    def noted(node: Column) -> Column:
        name = strip(F.regexp_replace(node["parent_tight"], _NOTED_PLACE, ""))
        return F.when(F.char_length(name) > 2, name)

    return F.coalesce(
        first_of(ranked_hits, place), first_of(F.get(buybox, F.lit(0))["ships_note"], noted)
    )


def seller_fields() -> list[Column]:
    """Columns from seller hits; ownership follows in :func:`with_ownership`."""
    box = F.get(F.col("buybox"), F.lit(0))
    return [
        seller_name(F.col("seller"), F.col("sold_by")).alias("seller_name"),
        is_fulfilled(F.col("fulfilment"), F.col("buybox")).alias("fulfilled_by_amazon"),
        seller_rating(F.col("seller_rating"), F.col("feedback")).alias("rated"),
        ships_from(F.col("ships_from"), F.col("buybox")).alias("ships_from"),
        F.when(box["rank"].isNotNull(), buybox_sold_by(F.col("buybox"))).alias("box_seller"),
        F.when(box["rank"].isNotNull(), box["text"]).alias("box_text"),
    ]


def with_ownership(table: DataFrame) -> DataFrame:
    """Whether the seller owns the buy box.

    The box names the marketplace: yes.  It names someone: equality of labels.  It
    names nobody: the seller's name must occur in it.
    """
    named = F.col("box_seller")
    seller = F.col("seller_name")
    owner = (
        F.when(is_marketplace_seller(named), F.lit(True))
        .when(named.isNotNull(), normalize_seller(named) == normalize_seller(seller))
        .otherwise(F.contains(F.lower("box_text"), F.lower(seller)))
    )
    return table.withColumns(
        {
            "seller_rating": F.col("rated")["rating"],
            "seller_rating_count": F.col("rated")["count"],
            "buybox_owner": F.coalesce(owner, F.lit(False)),
        }
    ).drop("rated", "box_seller", "box_text")


def sellers(hits: DataFrame, *, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The seller record of each hits row."""
    return with_ownership(hits.select(*keep, *seller_fields()))
