"""Token counts by a two-tier lookup on the map side.

A first pass over all texts counts pre-tokens in every task with a bounded counter (Misra-Gries: what is frequent
in a task survives). The tasks' few survivors are summed, and the ``FREQUENT`` largest become one
compact table: pre-token and its number of tokens, at most about 2 MB. It is broadcast. The second
pass sums lengths from that table; what is not in it is encoded and kept in the worker's own bounded
cache. Pre-tokens are never shuffled as such, only the tasks' survivors, and the table changes speed, not
results.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm._pretokens import Encoder, Pieces, encoder

FREQUENT = 1 << 15
PER_TASK = 1 << 13
COUNTED = 1 << 16  # entries of a task's counter
MAX_PIECE = 48  # bytes; longer pre-tokens are never in the table
CACHE_ENTRIES = 1 << 19


class Lengths(dict):
    """Pre-token to its number of tokens. The frequent ones stay; others come and go."""

    def __init__(self, model: Pieces, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.model, self.frequent = model, frequent

    def __missing__(self, piece: bytes) -> int:
        count = len(self.model.__missing__(piece)) // 4
        self.model.clear()
        if len(self) >= len(self.frequent) + CACHE_ENTRIES:
            self.clear()
            self.update(self.frequent)
        self[piece] = count
        return count


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [text or "" for text in batch.column(batch.schema.names.index("text")).to_pylist()]


def _shrink(counter: Counter) -> Counter:
    """Misra-Gries: take the same amount from all, so that at most half of the entries are left."""
    cut = sorted(counter.values(), reverse=True)[COUNTED // 2]
    return Counter({piece: n - cut for piece, n in counter.items() if n > cut})


def _survivors(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    cut, counter = encoder(path).pieces, Counter()
    for batch in batches:
        for text in _texts(batch):
            counter.update(cut(text) or ())
            if len(counter) > COUNTED:
                counter = _shrink(counter)
    top = [(p, n) for p, n in counter.most_common(PER_TASK) if len(p) <= MAX_PIECE]
    yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in top], kind) for i, kind in enumerate((pa.binary(), pa.int64()))], ["piece", "n"])


def frequent_lengths(texts: DataFrame, path: str) -> dict[bytes, int]:
    """The table: at most FREQUENT pre-tokens of at most MAX_PIECE bytes, with their token counts."""
    summed = texts.mapInArrow(partial(_survivors, path=path), "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [bytes(row.piece) for row in summed.orderBy(F.desc("n"), "piece").limit(FREQUENT).collect()]
    model = encoder(path).cache
    return {piece: len(model[piece]) // 4 for piece in top}


def packed(table: dict[bytes, int]) -> bytes:
    return zlib.compress(pickle.dumps((b"\0".join(table), bytes(min(n, 255) for n in table.values()))))


def unpacked(data: bytes) -> dict[bytes, int]:
    pieces, counts = pickle.loads(zlib.decompress(data))
    return dict(zip(pieces.split(b"\0"), counts, strict=True)) if counts else {}


_LENGTHS: dict[tuple[str, int], tuple[Encoder, Lengths]] = {}


def _lookup(path: str, table: Broadcast) -> tuple[Encoder, Lengths]:
    key = (path, hash(table.value))
    if key not in _LENGTHS:
        _LENGTHS.clear()
        using = encoder(path)
        _LENGTHS[key] = using, Lengths(Pieces(using.tokenizer), unpacked(table.value))
    return _LENGTHS[key]


def _count(batches: Iterator[pa.RecordBatch], path: str, table: Broadcast) -> Iterator[pa.RecordBatch]:
    using, lengths = _lookup(path, table)
    for batch in batches:
        sizes, counts = [], []
        for text in _texts(batch):
            pieces = using.pieces(text)
            sizes.append(len(text.encode()))
            counts.append(len(using.whole(text)) if pieces is None else sum(map(lengths.__getitem__, pieces)))
        place = batch.schema.names.index("text")
        rest = [i for i in range(batch.num_columns) if i != place]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in rest] + [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            [batch.schema.names[i] for i in rest] + ["n_bytes", "n_tokens"],
        )


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path`` is a byte-level BPE file of the tokenizers library that every executor can read. No special tokens are added;
    their strings inside a text count as the library counts them. A NULL text counts as empty: 0 and 0.
    Repeated rows and NULL ids are rows like others; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    table = frequent_lengths(rows.select("text"), path)
    sent = docs.sparkSession.sparkContext.broadcast(packed(table))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = rows.mapInArrow(partial(_count, path=path, table=sent), schema)
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
