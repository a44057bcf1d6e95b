"""Recurring lines by a tree of templates, with DataFrame functions alone.

The tree has a fixed depth. A line (its white space collapsed, tokens with a digit replaced by "<*>") goes first by
its number of tokens, then by its ``LEADING`` first tokens, to a leaf. In a leaf, a token is constant at its
position if lines of ``min_docs`` documents or more have it there, and variable otherwise. A line's template is its
tokens with variable ones replaced; lines of one leaf and one template are one pattern if at least half of its
tokens are constant. Lines whose pattern stands in ``min_docs`` documents or more are dropped from all.

A Bloom filter (as for exact duplicates) keeps lines whose leaf is theirs alone out of every shuffle. Templates are
compared by two commutative hash sums of their (position, token) pairs, so no line is put together
again; counts are combined before each shuffle, and a hot line, leaf or pattern is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm._joins import split_join
from shelfmark.llm.exact_dedup import filter_bits, maybe_repeated, repeated_positions
from shelfmark.session import work_folder

LEADING = 4
MIN_DOCS = 3
MIN_CONSTANT_PERCENT = 50
VARIABLE = "<*>"
DIGIT_TOKEN = "[^ ]*[0-9][^ ]*"
SEVERAL = ["  ", "\t", "\x0b", "\x0c", "\r"]  # white space that is not one space
LINE_WITH_A_WORD = r"[^\x20\x09-\x0D][^\n]*+"


def shaped(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the lines of ``text`` with single spaces, none at their ends, and "<*>" for every token that has a digit; NULL has one empty line.

    Texts are looked at whole, and lines only of those that hold digits; few are rewritten. Each step is a column of its own, so
    that none is worked out twice.
    """
    a, b, c = (f"{name}_{step}" for step in range(3))
    rows = rows.withColumn(a, F.coalesce(text, F.lit("")))
    several = F.lit(False)
    for run in SEVERAL:
        several = several | F.contains(F.col(a), F.lit(run))
    rows = rows.withColumn(b, F.when(several, F.regexp_replace(a, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(F.col(a)))
    ends = F.contains(F.col(b), F.lit(" \n")) | F.contains(F.col(b), F.lit("\n "))
    rows = rows.withColumn(c, _lines(F.trim(F.when(ends, F.regexp_replace(b, " ?\n ?", "\n")).otherwise(F.col(b)))))
    masked = F.transform(c, lambda line: F.when(line.rlike("[0-9]"), F.regexp_replace(line, DIGIT_TOKEN, VARIABLE)).otherwise(line))
    return rows.withColumn(name, F.when(F.col(a).rlike("[0-9]"), masked).otherwise(F.col(c))).drop(a, b, c)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _number(shaped: Column) -> Column:
    return F.length(shaped) - F.length(F.replace(shaped, F.lit(" "), F.lit(""))) + 1


def _row(id_column: str, text_column: str) -> Column:
    return F.xxhash64(F.col(id_column), F.col(text_column))


def recurring_lines(docs: DataFrame, folder: str, min_docs: int = MIN_DOCS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, shapes): for each document, by a hash of id and text, the hashes of its lines that recur."""
    spark = docs.sparkSession
    rows = shaped(docs.select(_row(id_column, text_column).alias("row"), F.col(text_column).alias("text")), F.col("text"), "shaped")
    lines = rows.select("row", F.explode(F.array_distinct("shaped")).alias("shaped")).filter("shaped <> ''")
    leaf = F.xxhash64(_number(F.col("shaped")), F.substring_index("shaped", " ", LEADING))
    lines = lines.select("row", "shaped", leaf.alias("leaf"))

    bits = filter_bits(8 * docs.count())
    pages = repeated_positions(lines.select("leaf"), "leaf", bits)
    shared = maybe_repeated(lines, "leaf", pages, bits, "repeated").filter("repeated").drop("repeated")
    shared.withColumn("shape", F.xxhash64("shaped")).write.parquet(f"{folder}/lines")
    shared = spark.read.parquet(f"{folder}/lines")  # row, shaped, leaf, shape

    shapes = shared.groupBy("shape").agg(F.count("*").alias("docs"), F.min("leaf").alias("leaf"), F.first("shaped").alias("shaped"))
    shapes.write.parquet(f"{folder}/shapes")
    shapes = spark.read.parquet(f"{folder}/shapes")
    leaves = shapes.groupBy("leaf").agg(F.sum("docs").alias("n")).filter(F.col("n") >= min_docs).select("leaf")
    tokens = split_join(shapes, leaves, ["leaf"]).select("shape", "leaf", "docs", F.posexplode(F.split("shaped", " ")).alias("at", "token"))
    tokens = tokens.select("shape", "leaf", "docs", "at", F.when(F.col("token") != VARIABLE, F.xxhash64("token")).alias("token"))
    constant = (
        tokens.filter("token IS NOT NULL").groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).filter(F.col("n") >= min_docs)
        .select("leaf", "at", "token", F.lit(1).alias("constant"))
    )
    seen = split_join(tokens, constant, ["leaf", "at", "token"], "left")
    shown = F.when(F.col("constant") == 1, F.col("token")).otherwise(0)
    patterns = seen.groupBy("shape", "leaf").agg(
        F.count("constant").alias("fixed"),
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("at", shown)).alias("h1"),
        F.bit_xor(F.xxhash64(shown, F.lit(7), "at")).alias("h2"),
    )
    patterns = patterns.filter(100 * F.col("fixed") >= MIN_CONSTANT_PERCENT * F.col("n")).select("shape", F.xxhash64("leaf", "h1", "h2").alias("pattern"))
    holding = shared.select("row", "shape").join(patterns, "shape")
    recurring = holding.select("row", "pattern").distinct().groupBy("pattern").count().filter(F.col("count") >= min_docs).select("pattern")
    dropped = split_join(holding, recurring, ["pattern"]).select("row", "shape")
    return dropped.groupBy("row").agg(F.collect_set("shape").alias("shapes"))  # at most a document's own lines


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, with recurring lines gone from the text, and ``n_lines`` (lines with a word) and
    ``n_dropped`` added (prefixed ``lines_`` where such a column exists).

    Rows that repeat an id and a text are one document (though each counts when constant tokens are found) and get the same
    result. Lines without a word are never dropped, and lines that stay keep their bytes and order. A NULL text stays NULL, with 0 lines; a text whose
    lines all recur becomes "".
    """
    folder = work_folder(docs.sparkSession, "line-dedup")
    dropped = recurring_lines(docs, folder, min_docs, id_column, text_column)
    n_lines, n_dropped = (f"lines_{n}" if n in docs.columns else n for n in ("n_lines", "n_dropped"))
    dropped.select(F.col("row").alias("lines_row"), F.col("shapes").alias("lines_gone")).write.parquet(f"{folder}/dropped")
    dropped = docs.sparkSession.read.parquet(f"{folder}/dropped")
    bits = filter_bits(dropped.count())
    pages = repeated_positions(dropped.select("lines_row"), "lines_row", bits, times=1)
    rows = maybe_repeated(docs.withColumn("lines_row", _row(id_column, text_column)), "lines_row", pages, bits, "lines_touched")
    # Texts that lose no line stay where they are.
    whole = rows.filter("NOT lines_touched").withColumn("lines_gone", F.lit(None).cast("array<bigint>"))
    touched = rows.filter("lines_touched").join(dropped, "lines_row", "left")

    def cut(rows: DataFrame) -> DataFrame:
        """The columns of a document after its lines went."""
        text, changed = F.col(text_column), F.col("lines_gone").isNotNull()
        rows = shaped(rows, F.when(changed, text), "lines_shaped")
        stays = F.filter(_lines(text), lambda line, i: ~F.array_contains("lines_gone", F.xxhash64(F.get("lines_shaped", i))))
        rows = rows.withColumn("lines_left", F.when(changed, stays))
        gone = F.when(changed, F.size("lines_shaped") - F.size("lines_left")).otherwise(0).cast("bigint")
        count = F.coalesce(F.regexp_count(text, F.lit(LINE_WITH_A_WORD)), F.lit(0)).cast("bigint")
        left = F.when(changed, F.concat_ws("\n", "lines_left")).otherwise(text)
        columns = [left.alias(name) if name == text_column else F.col(name) for name in docs.columns]
        return rows.select(*columns, count.alias(n_lines), gone.alias(n_dropped))

    return cut(whole).unionByName(cut(touched))
