"""Quality rules: counts over words and lines, and compression bands.

A text's zstandard ratio (bytes before to bytes after) tells repetition from noise: copied phrases compress far
better than prose, random or already packed text hardly at all. The ratio is taken over the whole text
and over fixed chunks, so that a long text cannot hide a bad stretch; what is usual depends on
length, so every band of lengths has limits of its own. What is usual also depends on the corpus, so ``fit`` sets the
limits just outside the range of texts labelled clean; the fixed limits, which only tell noise and extreme repetition, hold where there are
too few of these.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from io import BytesIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm._words import WHITE, WHITE_BYTES, windows, word_numbers
from shelfmark.operators.membership import possible

LEVEL = 3
CHUNK_BYTES = 4096
GROUP_BYTES = 1 << 22  # of texts measured together; the numbers of their words take some ten times that
# From so many bytes on: lowest and highest ratio of a text, where no labels say more.
LIMITS = ((0, 0.0, 5.0), (256, 1.25, 5.0), (1024, 1.50, 5.0), (4096, 1.60, 6.0), (16384, 1.70, 7.0), (65536, 1.70, 8.0))
# The same for chunks, and the share of a text's chunks that may lie outside.
CHUNK_LIMITS = (1.50, 8.0)
MAX_BAD_CHUNKS = 0.2

STARTS = (0, *(round(256 * 2 ** (i / 2)) for i in range(40)))  # fitted bands begin at so many bytes
MIN_TEXTS = 20  # clean texts that a band must have, or chunks that there must be, for limits of its own
MARGIN = 0.03  # of a limit, by which it lies outside the range of clean texts

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = (*((name, T.LongType()) for name in COUNTS), ("ratio", T.DoubleType()), ("n_chunks", T.LongType()), ("bad_chunks", T.LongType()))

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Limits:
    """``bands``: (from so many bytes on, lowest, highest ratio); ``chunks``: lowest and highest ratio of a chunk."""

    bands: tuple[tuple[int, float, float], ...] = LIMITS
    chunks: tuple[float, float] = CHUNK_LIMITS


def chunk_ratios(text: bytes, packer: zstandard.ZstdCompressor) -> list[float]:
    """Ratios of a text's chunks; a last chunk of under half the size, and a text of one chunk, join no count."""
    chunks = [text[at : at + CHUNK_BYTES] for at in range(0, len(text), CHUNK_BYTES)]
    chunks = [chunk for chunk in chunks if 2 * len(chunk) >= CHUNK_BYTES] if len(chunks) > 1 else []
    return [len(chunk) / len(packer.compress(chunk)) for chunk in chunks]


def ratios(text: bytes, packer: zstandard.ZstdCompressor, limits: tuple[float, float] = CHUNK_LIMITS) -> tuple[float, int, int]:
    """Ratio of the whole text, number of its chunks, and how many of them lie outside the limits.

    An empty text has ratio 1 and no chunk.
    """
    if not text:
        return 1.0, 0, 0
    low, high = limits
    chunks = chunk_ratios(text, packer)
    return len(text) / len(packer.compress(text)), len(chunks), sum(not low <= chunk <= high for chunk in chunks)


def repeated_words(runs: np.ndarray, words: int) -> int:
    """Words inside windows that occur twice or more; ``runs`` numbers a text's windows of 3 words."""
    if not len(runs):
        return 0
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    often = np.zeros(len(runs), dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    inside = np.zeros(words, dtype=bool)
    for step in range(3):
        inside[step : step + len(runs)] |= often
    return int(inside.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines are taken one at a time: a text of short lines is far smaller than a list of them."""
    count, seen = 0, set()
    for line in BytesIO(text):
        if line.strip(WHITE_BYTES):
            count += 1
            seen.add(line.removesuffix(b"\n"))
    return count - len(seen)


def measure(texts: list[bytes], limits: tuple[float, float] = CHUNK_LIMITS) -> list[tuple]:
    """FIELDS of every text; ``limits`` are those of chunks."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    numbers, begins = word_numbers(texts)
    runs = windows(numbers, 3)
    out = []
    for i, text in enumerate(texts):
        at, end = int(begins[i]), int(begins[i + 1])
        codes = np.frombuffer(text, dtype=np.uint8)
        characters = int(((codes & 0xC0) != 0x80).sum()) - int(WHITE[codes].sum())
        out.append(
            (
                end - at,
                characters,
                int(_SYMBOL[codes].sum()),
                duplicate_lines(text),
                repeated_words(runs[at : max(at, end - 2)], end - at),
                *ratios(text, packer, limits),
            )
        )
    return out


def _groups(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch, at most GROUP_BYTES of them at a time (a longer one alone); none is left out."""
    texts: list[bytes] = []
    size = 0
    for value in column.cast(pa.binary()):
        text = value.as_py() or b""
        if texts and size + len(text) > GROUP_BYTES:
            yield texts
            texts, size = [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield texts


def _measured(batches: Iterator[pa.RecordBatch], limits: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = batch.schema.names.index("quality_text")
        rows = [row for texts in _groups(batch.column(place)) for row in measure(texts, limits)]
        kept = [i for i in range(batch.num_columns) if i != place]
        columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
        kinds = (pa.int64(),) * len(COUNTS) + (pa.float64(), pa.int64(), pa.int64())
        made = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + made, [batch.schema.names[i] for i in kept] + [f"quality_{n}" for n, _ in FIELDS])


def _base_failed(words: Column, repeated: Column) -> Column:
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


_RANGES = "band int, n_words bigint, n_repeat_words bigint, ratio double, chunks bigint, low double, high double"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to their ids and _RANGES."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        out = []
        for text, row in (pair for texts in _groups(batch.column(1)) for pair in zip(texts, measure(texts), strict=True)):
            chunks = chunk_ratios(text, packer)
            band = bisect_right(STARTS, len(text)) - 1
            out.append((band, row[0], row[4], row[5], len(chunks), min(chunks, default=None), max(chunks, default=None)))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
        columns = zip(*out, strict=True) if out else [[] for _ in kinds]
        made = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", *(field.split()[0] for field in _RANGES.split(", "))])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "quality") -> Limits:
    """Limits just outside the range of texts labelled clean (1) that pass the base rules; ``usable`` says which ids may be used.

    Rows with a NULL id or label are left out, an id counts once (with its least label). All clean texts count, however many;
    a Bloom filter of their ids picks them where they are read, where they are measured too; only measures meet the labels, in a join that
    Spark chooses, and one row a band comes back. Bands and chunks with fewer than MIN_TEXTS keep the fixed limits, so a text longer
    than all clean ones is judged by its chunks.
    """
    same = docs.schema[id_column].dataType  # the filter hashes ids by their type
    rows = labels.select(F.col(id_column).cast(same).alias("id"), F.col(label_column).cast("int").alias("label")).dropna()
    if usable is not None:
        rows = rows.filter(usable)
    clean = rows.groupBy("id").agg(F.min("label").alias("label")).filter("label = 1").select("id")
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    made = T.StructType([texts.schema["id"], *T.StructType.fromDDL(_RANGES).fields])
    known = possible(texts, F.col("id"), clean).mapInArrow(_ranges, made).join(clean, "id")
    known = known.filter(~_base_failed(F.col("n_words"), F.col("n_repeat_words")))
    found = known.groupBy("band").agg(
        F.count("*").alias("n"), F.min("ratio").alias("least"), F.max("ratio").alias("most"),
        F.sum("chunks").alias("chunks"), F.min("low").alias("low"), F.max("high").alias("high"),
    ).collect()
    fitted = {r.band: (r.least * (1 - MARGIN), r.most * (1 + MARGIN)) for r in found if r.n >= MIN_TEXTS}
    bands: list[tuple[int, float, float]] = []
    for band, start in enumerate(STARTS):
        limits = fitted.get(band) or LIMITS[bisect_right([s for s, _, _ in LIMITS], start) - 1][1:]
        if not bands or bands[-1][1:] != limits:
            bands.append((start, *limits))
    chunked = [r for r in found if r.chunks]
    if sum(r.chunks for r in chunked) < MIN_TEXTS:
        return Limits(tuple(bands))
    return Limits(tuple(bands), (min(r.low for r in chunked) * (1 - MARGIN), max(r.high for r in chunked) * (1 + MARGIN)))


def quality(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """The columns ``keep`` (all by default) and, prefixed ``quality_``, FIELDS, ``base_failed`` and ``kept``.

    Words are runs of bytes other than ASCII white space. ``base_failed``: fewer than 50 words, or more than half of the
    words stand in three-word windows that occur twice or more. ``kept`` is false then, and where the
    text's ratio leaves its length's band or more than a fifth of its chunks leave theirs. A NULL text is an empty one: no
    words, so ``base_failed``. Nothing depends on other rows.
    """
    names = docs.columns if keep is None else keep
    rows = docs.select(*names, F.col(text_column).alias("quality_text"))
    fields = [f for f in rows.schema.fields if f.name != "quality_text"] + [T.StructField(f"quality_{n}", kind) for n, kind in FIELDS]
    rows = rows.mapInArrow(partial(_measured, limits=limits.chunks), T.StructType(fields))
    return rows.withColumn("quality_base_failed", _base_failed(F.col("quality_n_words"), F.col("quality_n_repeat_words")))


def judged(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """``quality`` with ``quality_kept``."""
    size = F.octet_length(F.coalesce(F.col(text_column), F.lit("")))
    names = docs.columns if keep is None else keep
    rows = quality(docs.withColumn("quality_bytes", size.cast("bigint")), text_column, [*names, "quality_bytes"], limits)
    low = high = F.lit(None).cast("double")
    for start, least, most in limits.bands:
        low = F.when(F.col("quality_bytes") >= start, least).otherwise(low)
        high = F.when(F.col("quality_bytes") >= start, most).otherwise(high)
    chunks = F.col("quality_bad_chunks") <= MAX_BAD_CHUNKS * F.col("quality_n_chunks")
    kept = ~F.col("quality_base_failed") & F.col("quality_ratio").between(low, high) & chunks
    return rows.withColumn("quality_kept", kept)


def quality_filter(docs: DataFrame, text_column: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judged(docs, text_column, limits=limits).filter("quality_kept").select(*docs.columns)
