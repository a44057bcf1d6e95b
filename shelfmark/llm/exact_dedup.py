"""Exact duplicates by two passes over a Bloom filter, with DataFrame functions alone.

Pass one hashes every normalised text to a few positions of a bit array and counts rows
per position; only positions (8 bytes each, combined before the shuffle) move. Positions hit
twice or more become a dense bit array. Pass two looks every row's positions up in it: a row with
a position that nobody else hit is alone and passes straight through. Only the others shuffle, by
SHA-256 of the normalised text, and are grouped exactly, so false positives change nothing.

The array has ``BITS_PER_ROW`` bits a row, at most ``MAX_BITS`` (128 MB), which bounds the
broadcast. Beyond that many rows the filter lets more lone rows through to the shuffle; results
stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm._joins import split_join

HASHES = 2
BITS_PER_ROW = 16
MAX_BITS = 1 << 30
MIN_BITS = 1 << 15
WORD, PAGE_WORDS = 64, 512
PAGE = WORD * PAGE_WORDS

WHITE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " ")


def filter_bits(rows: int) -> int:
    """Bits of the filter: a power of two."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (rows * BITS_PER_ROW - 1).bit_length() if rows else MIN_BITS))


def _positions(value: Column, bits: int) -> list[Column]:
    hashed = F.xxhash64(value)
    return [F.shiftrightunsigned(hashed, 32 * i).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


def repeated_positions(values: DataFrame, column: str, bits: int, times: int = 2) -> DataFrame:
    """The filter: (page, words), a page of 64-bit words; bits hit by ``times`` rows or more are set."""
    hit = values.select(F.explode(F.array_distinct(F.array(*_positions(F.col(column), bits)))).alias("p"))
    often = hit.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") >= times)
    mark = F.expr(f"shiftleft(1L, CAST(p % {WORD} AS INT))")
    words = often.groupBy(F.expr(f"p DIV {WORD}").alias("w")).agg(F.bit_or(mark).alias("marks"))
    entry = F.struct(F.expr(f"CAST(w % {PAGE_WORDS} AS INT)"), F.col("marks"))
    pages = words.groupBy(F.expr(f"w DIV {PAGE_WORDS}").alias("page")).agg(F.map_from_entries(F.collect_list(entry)).alias("some"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(PAGE_WORDS - 1)), lambda i: F.coalesce(F.col("some")[i], F.lit(0).cast("bigint")))
    return pages.select("page", dense.alias("words"))


def maybe_repeated(rows: DataFrame, column: str, pages: DataFrame, bits: int, flag: str) -> DataFrame:
    """The rows with a boolean: false only for values that occur once."""
    hit = F.lit(True)
    for i, position in enumerate(_positions(F.col(column), bits)):
        here = pages.select(F.col("page").alias(f"{flag}_page{i}"), F.col("words").alias(f"{flag}_words{i}"))
        rows = rows.withColumn(f"{flag}_p{i}", position)
        rows = rows.join(F.broadcast(here), F.expr(f"{flag}_p{i} DIV {PAGE} = {flag}_page{i}"), "left")
        word = F.expr(f"element_at({flag}_words{i}, CAST({flag}_p{i} DIV {WORD} % {PAGE_WORDS} AS INT) + 1)")
        bit = F.expr(f"CAST({flag}_p{i} % {WORD} AS INT)")
        hit = hit & F.coalesce(F.call_function("getbit", word, bit) == 1, F.lit(False))
    return rows.withColumn(flag, hit).drop(*(f"{flag}_{x}{i}" for i in range(HASHES) for x in ("p", "page", "words")))


def _groups(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows that the filter finds alone, the other rows with their groups, and the names of the added columns."""
    bits = filter_bits(docs.count())
    text = normalised(F.col(text_column))
    pages = repeated_positions(docs.select(text.alias("t")), "t", bits)
    names = [f"exact_{n}" if n in docs.columns else n for n in ("keep_id", "group_size", "kept", "text_sha256")]
    keep, size, kept, sha = names
    rows = maybe_repeated(docs.withColumn("exact_text", text), "exact_text", pages, bits, "exact_maybe")
    rows = rows.withColumn(sha, F.sha2("exact_text", 256)).drop("exact_text")

    alone = rows.filter(~F.col("exact_maybe")).select(
        *docs.columns, F.col(id_column).alias(keep), F.lit(1).cast("bigint").alias(size), F.lit(True).alias(kept), sha
    )
    maybe = rows.filter("exact_maybe").drop("exact_maybe")
    groups = maybe.groupBy(sha).agg(F.min(id_column).alias(keep), F.count("*").alias(size))
    grouped = split_join(maybe, groups, [sha])
    grouped = grouped.withColumn(kept, F.col(id_column).eqNullSafe(F.col(keep)))
    return alone, grouped.select(*docs.columns, *names), names


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` added (prefixed
    ``exact_`` where that name exists).

    Texts are equal if they agree after every run of white space has become one space; NULL counts as
    empty, and empty texts are equal to each other. ``keep_id`` is a group's least id; NULL ids count
    in ``group_size`` and never become ``keep_id`` unless a group has no other. Rows that repeat an id and a text
    are one document told twice: they get the same values.
    """
    alone, grouped, _ = _groups(docs, id_column, text_column)
    return alone.unionByName(grouped)


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, one for each text: the row with the least id (NULL only if there is no
    other). Of rows that repeat an id and a text one stays.
    """
    alone, grouped, (_, _, kept, sha) = _groups(docs, id_column, text_column)
    first = grouped.filter(F.col(kept)).dropDuplicates([sha])
    return alone.select(*docs.columns).union(first.select(*docs.columns))
