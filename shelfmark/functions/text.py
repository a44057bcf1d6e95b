"""Column helpers shared by the field rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s and \d are ASCII unless (?U) is set; pages carry no-break spaces and other digits.
# All of Unicode's white space, and the separators that Python counts as such.
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Remove all Unicode white space at both ends."""
    return F.btrim(text, F.lit(_SPACE))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern``, or NULL where there is none or it is empty."""
    return filled(F.regexp_extract(text, pattern, group))


def filled(text: Column) -> Column:
    """NULL for an empty text.  ``nullif`` inside a lambda would work its argument out twice, and nested ones four times."""
    return F.get(F.array_remove(F.array(text), F.lit("")), F.lit(0))


def first_of(hits: Column, value: Callable[[Column], Column]) -> Column:
    """The first non-NULL ``value(hit)`` of a rank-ordered hit array."""
    return F.get(F.filter(F.transform(hits, value), lambda v: v.isNotNull()), F.lit(0))


def first_text(hits: Column) -> Column:
    """Text of the first hit that has any."""
    return first_of(hits, lambda hit: filled(hit["text"]))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it.

    Lambdas see outer expressions by text, so ``value`` would run again per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ordered_distinct(items: Column, key: Callable[[Column], Column]) -> Column:
    """Keep each item whose ``key`` has no earlier equal; order stays."""

    def pick(rows: Column) -> Column:
        def firsts(keys: Column) -> Column:
            found = F.filter(rows, lambda _, at: F.array_position(keys, F.get(keys, at)) == at + 1)
            return F.when(F.size(F.array_distinct(keys)) == F.size(keys), rows).otherwise(found)

        return bind(F.transform(rows, key), firsts)

    return bind(items, pick)


def ascii_digits(text: Column) -> Column:
    """Arabic-Indic, Persian and full-width digits as 0-9, so that casts accept them."""
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９", "0123456789" * 3)


def _sql(value: str | int) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(table: dict, key: Column) -> Column:
    """``table[key]`` for a small fixed table, NULL where the key is not in it."""
    entries = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)
