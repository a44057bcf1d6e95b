"""Prices, discounts and ratings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import ascii_digits, bind, extract, filled, lookup, strip
from shelfmark.rules import CURRENCY

MONEY = "decimal(18,2)"

# Number shapes by locale.
_COMMA_DECIMAL = r"^\d+(?:\.\d{3})*(?:,\d{1,2})?$"
_COMMA_GROUPS = r"^\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?$"
_DOT_DECIMAL = r"^\d+(?:\.\d{1,2})?$"
_DOT_GROUPS = r"^\d{1,3}(?:\.\d{3})+$"
# Price inside a sentence ("Was: $39.99", "List Price: 1.234,56 €").
PRICE_IN_TEXT = (
    r"(?U)(?:US\$|CDN\$|MX\$|R\$|A\$|C\$|S\$|HK\$|₹|€|£|¥|\$)\s*\d+(?:[.,]\d{1,3})*(?:[.,]\d{1,2})?"
    r"|\d+(?:\.\d{3})*(?:,\d{1,2})?\s*(?:€|£|¥|₹|\$)"
)
# Price inside rendered text, symbol in front or behind.
PRICE_RENDERED = (
    rf"(?U){CURRENCY}\s*\d+(?:,\d{{3}})*(?:\.\d{{1,2}})?|\d+(?:\.\d{{3}})*(?:,\d{{1,2}})?\s*{CURRENCY}"
)
# Currency markers a valid price may carry.
_MARKERS = [
    "US$", "MX$", "R$", "A$", "C$", "S$", "HK$", "CDN$", "$", "£",
    "€", "¥", "₹", "₩", "₽", "zł", "Rp", "RM",
]
# Fixed value: a number as valid prices show it.
_NUMERIC = (
    r"\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?|\d{1,3}(?:\.\d{3})+,\d{1,2}|\d+(?:,\d{1,2})?"
)
# Fixed values: "X out of 5" in the shops' languages.
_RATING_PHRASE = r"(?iU)(\d+[.,]?\d*)\s*(?:von|sur|de|su|av|aus|van|da|af|di|over|of|out\s*of)\s*5\b"
# Fixed value: a number from 0 to 5 as valid ratings show it.
_RATING_NUMBER = r"(?:[0-4](?:\.[0-9])?|5(?:\.0)?)"


def amount(price: Column) -> Column:
    """Price text to DECIMAL; NULL unless the digits form one well-formed number.

    With a comma the comma-decimal reading is tried first ("1.234,56"), then comma
    thousands ("1,299.99"); without one, dot decimal, then dot thousands ("1.234").
    """
    number = ascii_digits(F.regexp_replace(price, r"(?U)[^\d.,]", ""))
    return bind(number, _plain_number).try_cast(MONEY)


def _plain_number(digits: Column) -> Column:
    """Digits, commas and dots as a number with a decimal dot, NULL if they form none."""
    return (
        F.when(
            F.contains(digits, F.lit(",")),
            F.when(digits.rlike(_COMMA_DECIMAL), F.translate(digits, ",.", "."))
            .when(digits.rlike(_COMMA_GROUPS), F.replace(digits, F.lit(","), F.lit(""))),
        )
        .when(digits.rlike(_DOT_DECIMAL), digits)
        .when(digits.rlike(_DOT_GROUPS), F.replace(digits, F.lit("."), F.lit("")))
    )


def has_currency(text: Column) -> Column:
    return text.rlike(CURRENCY)


def currency_symbol(price: Column) -> Column:
    return F.coalesce(extract(price, CURRENCY), F.lit("$"))


def savings(current: Column, original: Column) -> Column:
    """Amount saved, NULL unless both prices are positive and the original is higher."""
    return F.when((current > 0) & (original > current), original - current)


def discount_percent(current: Column, original: Column) -> Column:
    """Whole percent saved, rounded down, in exact cents (71 of 100 is 29 % off, not 28)."""
    saved = (savings(current, original) * 100).cast("bigint")
    return F.when(saved.isNotNull(), F.call_function("div", saved * 100, (original * 100).cast("bigint")))


def price_is_valid(price: Column) -> Column:
    """Exactly one currency marker, in front or behind, next to a strict number."""
    text = strip(price)
    marker = "|".join(m.replace("$", r"\$") for m in _MARKERS)
    lead, trail = text.rlike(f"^(?:{marker})"), text.rlike(f"(?:{marker})\\z")
    shape = text.rlike(rf"(?U)^(?:(?:{marker})\s*(?:{_NUMERIC})|(?:{_NUMERIC})\s*(?:{marker}))\z")
    return F.coalesce((lead != trail) & shape, F.lit(False))


def rating_is_valid(rating: Column) -> Column:
    """"4.5 out of 5", "4.5", "4.5/5", or one word before the number ("Rated: 4.5/5")."""
    shape = (
        rf"(?U)^(?:{_RATING_NUMBER}(?:\s+out\s+of\s+5|/5)?"
        rf"|[A-Za-z]+\s*[:\-]?\s*{_RATING_NUMBER}(?:\s*/\s*5)?)\z"
    )
    return F.coalesce(strip(rating).rlike(shape), F.lit(False))


# x.x5 in binary lies above, below or on the middle; each case rounded as ``%.1f`` prints it.
_TIES = {f"{cent / 100:.2f}": f"{cent / 100:.1f}" for cent in range(5, 500, 10)}


def normalize_rating(text: Column) -> Column:
    """Localized rating text to "X out of 5"; a bare dot-decimal number stays as it is."""
    def in_phrase(text: Column) -> Column:
        number = F.translate(F.regexp_extract(text, _RATING_PHRASE, 1), ",", ".")
        return bind(number, lambda number: bind(filled(number), lambda value: _rating(text, value)))

    return bind(strip(text), in_phrase)


def _rating(text: Column, value: Column) -> Column:
    """Of the whole text and the number in its phrase (NULL without one)."""

    def told(number: Column) -> Column:
        tenths = F.coalesce(
            lookup(_TIES, F.when(number == F.round(number, 2), F.round(number, 2).cast("string"))),
            F.round(number, 1).try_cast("decimal(2,1)").cast("string"),
        )
        short = F.when(value.rlike(r"(?U)\.\d{2,}$"), tenths).otherwise(value)
        return F.when(number.between(0, 5), F.concat(short, F.lit(" out of 5")))

    bare = extract(text, r"(?U)^\d+\.?\d*\z")
    return F.when(value.isNull(), bare).otherwise(bind(ascii_digits(value).try_cast("decimal(38,18)"), told))


def rating_value(rating: Column) -> Column:
    """Typed sibling of a normalized rating."""
    return ascii_digits(extract(rating, r"(?U)^(\d+\.?\d*)(?: out of 5)?\z", 1)).try_cast("decimal(4,1)")


def digits_only(text: Column) -> Column:
    """"19,665 global ratings" to "19665"; NULL without any digit."""
    return filled(F.regexp_replace(text, r"(?U)[^\d]", ""))
