"""BPE encoding and decoding through a table of distinct words.

Texts are cut into words in Spark, a block (some MB of text) at a time. A block keeps each of its words once,
dealt by a hash to buckets, and every text as the sequence of its words' numbers. All blocks' lists
of one bucket meet in one task, where every distinct word of the bucket is encoded once. The ids go
back to their blocks in the lists' own order, so a text's ids are a lookup by position; decoding
joins them with the id-to-piece table. Words travel once a block, in compressed lists, and texts
as compressed numbers. Buckets follow the number of documents, so a bucket's lists stay bounded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm._pretokens import Pieces, load
from shelfmark.session import work_folder

BLOCK_BYTES = 32 << 20  # of text
GROUP_WORDS = 1 << 18  # words of the texts that share a row
BUCKET_DOCS = 20_000
MIN_BUCKETS = 16
LEVEL = 3
WORDS, NUMBERS, TEXTS = 0, 1, 2

# Fixed value: the word pattern of the tokenizer file, for the characters of _PLAIN in lower case.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ɏß]+|[0-9]|[^\\sa-zà-öø-ɏß0-9]+")
_LETTERS = re.compile("[a-zà-öø-ɏß]+")
# Texts of these characters alone are cut by one pattern; others by the tokenizer's own normaliser and splitter. The small forms of
# some capitals (Ə, Ɔ, Ɛ, İ) are not among the pattern's letters.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e" + "".join(c for c in map(chr, range(0xC0, 0x250)) if _LETTERS.fullmatch(c.lower())) + "]*")


class Splitter:
    """A text as words of the tokenizer (after its normaliser) and special tokens, in order."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {token.content: number for number, token in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if added else None

    def split(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self._words(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _WORD.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


_SPLITTERS: dict[str, Splitter] = {}


def _splitter(path: str) -> Splitter:
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes: high planes are nearly empty and pack well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


class _Block:
    """Texts of a block: words numbered as they come, at the end by falling frequency."""

    def __init__(self) -> None:
        self.words, self.ids, self.texts, self.size = _Numbers(), [], [], 0

    def add(self, document, words: list[str], size: int) -> None:
        self.ids.append(document)
        self.texts.append(np.fromiter(map(self.words.__getitem__, words), dtype=np.uint32, count=len(words)))
        self.size += size

    def rows(self, buckets: int) -> Iterator[dict]:
        packer, block = zstandard.ZstdCompressor(level=LEVEL), uuid4().hex
        counts = np.bincount(np.concatenate(self.texts), minlength=len(self.words))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        names = list(self.words)
        ranked = [names[i].encode() for i in order]
        dealt = np.array([zlib.crc32(word) % buckets for word in ranked], dtype=np.uint32)
        for bucket in np.unique(dealt):
            listed = b"\n".join(ranked[i] for i in np.flatnonzero(dealt == bucket))
            yield {"block": block, "kind": WORDS, "bucket": int(bucket), "row": 0, "ids": [], "data": packer.compress(listed)}
        yield {"block": block, "kind": NUMBERS, "bucket": 0, "row": 0, "ids": [], "data": packer.compress(_planes(dealt))}
        begin = held = row = 0
        for i, text in enumerate(self.texts):
            held += len(text)
            if held >= GROUP_WORDS or i + 1 == len(self.texts):
                some = self.texts[begin : i + 1]
                sizes = np.array([len(some), *map(len, some)], dtype="<u4").tobytes()
                data = packer.compress(sizes + _planes(rank[np.concatenate(some)]))
                yield {"block": block, "kind": TEXTS, "bucket": 0, "row": row, "ids": self.ids[begin : i + 1], "data": data}
                begin, held, row = i + 1, 0, row + 1


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("block", pa.string()), ("kind", pa.int8()), ("bucket", pa.int32()), ("row", pa.int32()), ("ids", pa.list_(kind)), ("data", pa.binary())])


def _split(batches: Iterator[pa.RecordBatch], path: str, buckets: int) -> Iterator[pa.RecordBatch]:
    split, block, schema = _splitter(path).split, _Block(), None
    for batch in batches:
        schema = schema or _schema(batch.schema.field(0).type)
        for document, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            block.add(document, split(text or ""), len(text or ""))
            if block.size >= BLOCK_BYTES:
                for row in block.rows(buckets):
                    yield pa.RecordBatch.from_pylist([row], schema)
                block = _Block()
    if block.ids:
        for row in block.rows(buckets):
            yield pa.RecordBatch.from_pylist([row], schema)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Word lists, sorted by bucket, to lists of ids: first the ids' number for each word, then all ids."""
    splitter = _splitter(path)
    special = {word.encode(): np.array([number], dtype="<u4").tobytes() for word, number in splitter.special.items()}
    packer, unpacker = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    table, now = Pieces(splitter.tokenizer, 1 << 62), None
    for batch in batches:
        blocks, buckets, data = (batch.column(i).to_pylist() for i in range(3))
        for block, bucket, listed in zip(blocks, buckets, data, strict=True):
            if bucket != now:
                table.clear()
                table.update(special)
                now = bucket
            found = [table[word] for word in unpacker.decompress(listed).split(b"\n")]
            sizes = np.array([len(f) // 4 for f in found], dtype=np.uint32)
            ids = np.frombuffer(b"".join(found), dtype="<u4")
            out = packer.compress(np.array([len(found)], "<u4").tobytes() + _planes(sizes) + _planes(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([bucket], pa.int32()), pa.array([out], pa.binary())], ["block", "bucket", "data"]
            )


class _Table:
    """A block's words by number: their ids and their pieces."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.sizes, self.ids = pieces, [], []

    def answer(self, data: bytes) -> None:
        many = int(np.frombuffer(data, "<u4", 1)[0])
        self.sizes.append(_numbers(data[4 : 4 + 4 * many]))
        self.ids.append(_numbers(data[4 + 4 * many :]))

    def settle(self, dealt: np.ndarray) -> None:
        """``dealt`` has the bucket of every word number; the answers came in order of buckets."""
        sizes, ids = np.concatenate(self.sizes).astype(np.int64), np.concatenate(self.ids)
        ends = np.cumsum(sizes)
        order = np.argsort(dealt, kind="stable")
        self.starts, self.counts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        self.starts[order], self.counts[order] = ends - sizes, sizes
        self.flat = ids
        names = np.array(self.pieces, dtype=object)[ids].tolist()
        bounds = zip((ends - sizes).tolist(), ends.tolist(), strict=True)
        joined = np.empty(len(order), dtype=object)
        joined[order] = [" ".join(names[a:b]) for a, b in bounds]
        self.decoded = joined.tolist()

    def text(self, numbers: np.ndarray) -> tuple[bytes, str]:
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - counts), counts)
        return self.flat[at].astype("<u4").tobytes(), " ".join(map(self.decoded.__getitem__, numbers.tolist()))


def _join(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows of a block follow each other: answers by bucket, the numbers' buckets, the texts."""
    tokenizer = _splitter(path).tokenizer
    pieces = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    unpacker, now, table, dealt, settled = zstandard.ZstdDecompressor(), None, None, None, False
    for batch in batches:
        kind_of_id = batch.schema.field("ids").type.value_type
        rows = zip(*(batch.column(batch.schema.names.index(n)).to_pylist() for n in ("block", "kind", "ids", "data")), strict=True)
        for block, kind, documents, packed in rows:
            data = unpacker.decompress(packed)
            if block != now:
                now, table, settled = block, _Table(pieces), False
            if kind == WORDS:
                table.answer(data)
            elif kind == NUMBERS:
                dealt = _numbers(data)
            else:
                if not settled:
                    if len(dealt):
                        table.settle(dealt)
                    settled = True
                many = int(np.frombuffer(data, "<u4", 1)[0])
                sizes = np.frombuffer(data, "<u4", many, 4).astype(np.int64)
                numbers = _numbers(data[4 + 4 * many :])
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                for at in range(0, many, 256):
                    part = range(at, min(at + 256, many))
                    made = [table.text(numbers[bounds[i] : bounds[i + 1]]) if sizes[i] else (b"", "") for i in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([documents[i] for i in part], kind_of_id), pa.array([len(m[0]) // 4 for m in made], pa.int64()),
                         pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())],
                        ["id", "n_tokens", "ids", "decoded"],
                    )


def bpe_round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids`` (binary, 32-bit little-endian) and ``decoded`` (the pieces of the ids, joined
    by spaces, special tokens included).

    ``path`` is a tokenizer file of the tokenizers library with a normaliser and a splitter into words that hold no white
    space, readable by every executor. No special tokens are added; their strings in a text become
    their ids, as in the library. NULL and empty texts, and texts without words, have no ids and decode to "". Repeated
    rows and NULL ids are rows like others. An empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "bpe")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType
    buckets = max(MIN_BUCKETS, -(-docs.count() // BUCKET_DOCS))
    schema = T.StructType(
        [
            T.StructField("block", T.StringType()),
            T.StructField("kind", T.ByteType()),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("row", T.IntegerType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("data", T.BinaryType()),
        ]
    )
    rows.mapInArrow(partial(_split, path=path, buckets=buckets), schema).write.parquet(f"{folder}/blocks")
    blocks = spark.read.schema(schema).parquet(f"{folder}/blocks")
    lists = blocks.filter(F.col("kind") == WORDS).select("block", "bucket", "data")
    answers = (
        lists.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(partial(_encode, path=path), "block string, bucket int, data binary")
        .select("block", F.lit(WORDS).cast("tinyint").alias("kind"), "bucket", F.lit(0).alias("row"), F.array().cast(T.ArrayType(kind)).alias("ids"), "data")
    )
    together = answers.union(blocks.filter(F.col("kind") != WORDS).select(answers.columns))
    out = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("decoded", T.StringType()),
        ]
    )
    found = together.repartition("block").sortWithinPartitions("block", "kind", "bucket", "row").mapInArrow(partial(_join, path=path), out)
    return found.withColumnRenamed("id", id_column)
