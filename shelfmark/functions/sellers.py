"""Seller label comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import strip

# Labels of the marketplace itself, after normalization.
MARKETPLACE_SELLERS = ["amazon", "amazon.com", "amazon.com, inc."]


def normalize_seller(name: Column) -> Column:
    """Without a leading "Visit the / Brand: / Sold by:", end punctuation and case."""
    bare = F.regexp_replace(strip(name), r"(?iU)^(?:visit\s+the|brand:?\s*|sold\s+by:?\s*)", "")
    return F.lower(strip(F.regexp_replace(bare, r"(?U)[\s.,!?;:]+\z", "")))


def is_marketplace_seller(name: Column) -> Column:
    # End punctuation is already gone, so the third label can only match without its dot.
    return F.coalesce(normalize_seller(name).isin(MARKETPLACE_SELLERS), F.lit(False))
