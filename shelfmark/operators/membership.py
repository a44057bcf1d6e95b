"""A test of membership that stays on the map side.

Wanted keys become a Bloom filter: a bit array of checked size that is broadcast.  Rows whose key
cannot be wanted are dropped where they are read, before their page text is parsed or moved.
A few others pass as well, so an exact join (on small rows) must follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most 16 MB to broadcast, less for few keys; ten million keys let one other row in a hundred pass.
# With more keys than the array serves, more rows pass; results stay the same.
BITS = 1 << 27
_WORD, _PAGE = 64, 1 << 12
_HASHES = 3


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit(bits - 1)) for seed in range(_HASHES)]


def _pages(keys: DataFrame, bits: int) -> DataFrame:
    """(page, words): the bit array, cut into pages of 64 words; pages without a key are left out."""
    hit = keys.select(F.explode(F.array(*_positions(F.col("key"), bits))).alias("p"))
    mark = F.expr(f"shiftleft(1L, CAST(p % {_WORD} AS INT))")
    words = hit.groupBy(F.expr(f"p DIV {_WORD}").alias("w")).agg(F.bit_or(mark).alias("marks"))
    entry = F.struct(F.expr(f"CAST(w % {_PAGE // _WORD} AS INT)"), F.col("marks"))
    pages = words.groupBy(F.expr(f"w DIV {_PAGE // _WORD}").alias("page"))
    some = pages.agg(F.map_from_entries(F.collect_list(entry)).alias("some"))  # at most 64 entries
    places = F.sequence(F.lit(0), F.lit(_PAGE // _WORD - 1))
    return some.select("page", F.transform(places, lambda i: F.coalesce(F.col("some")[i], F.lit(0).cast("bigint"))).alias("words"))


def possible(table: DataFrame, key: Column, wanted: DataFrame, *, bits: int = BITS) -> DataFrame:
    """Rows of ``table`` whose ``key`` may be among the rows of ``wanted`` (one column); no shuffle of ``table``.

    A row with a NULL key passes only if NULL is wanted.  ``bits`` is a power of two.
    """
    pages = _pages(wanted.toDF("key"), bits)
    out = table
    for i, position in enumerate(_positions(key, bits)):
        here = pages.select(F.col("page").alias(f"_page{i}"), F.col("words").alias(f"_words{i}"))
        out = out.withColumn(f"_p{i}", position).join(F.broadcast(here), F.expr(f"_p{i} DIV {_PAGE} = _page{i}"))
        bit = f"getbit(element_at(_words{i}, CAST(_p{i} % {_PAGE} DIV {_WORD} AS INT) + 1), CAST(_p{i} % {_WORD} AS INT))"
        out = out.where(f"{bit} = 1").drop(f"_p{i}", f"_page{i}", f"_words{i}")
    return out
