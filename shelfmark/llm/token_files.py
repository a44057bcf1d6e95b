"""Token ids in binary files: patched frame-of-reference blocks.

File layout, little-endian: magic, the blocks, the footer, the footer's length (8 bytes). A block holds
``BLOCK`` ids: its least id (4 bytes), the width (1), the number of exceptions (2), the lowest ``width``
bits of every id less the least (ids side by side in 64-bit words), and the exceptions as positions (2
bytes each) and whole differences (4 bytes each). The width is the ``PERCENTILE`` of the block's bit lengths. The
footer has the number of ids, every block's start, and every document's id and first token.

Documents are dealt to files by ranges of their id; a file's documents, and the files, ascend.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm._files import opened, reachable
from shelfmark.llm._pretokens import encoder
from shelfmark.session import work_folder

MAGIC = b"PFORIDS1"
BLOCK = 256
PERCENTILE = 0.9
SEGMENT = 1 << 20  # ids that are packed at once
END_ID = 2
MANIFEST = "part int, path string, documents bigint, ids bigint, bytes bigint"
_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
_POSITION, _WHOLE = np.dtype("<u2"), np.dtype("<u4")


def _words(width: int) -> int:
    return BLOCK * width // 64


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK numbers below 2**width as rows of 64-bit words."""
    columns = np.ascontiguousarray(values.T.astype(np.uint64))
    out = np.zeros((_words(width), len(values)), dtype=np.uint64)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    rows = len(words)
    columns = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, rows), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        out[i] = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= columns[word + 1] << np.uint64(64 - shift)
        out[i] &= mask
    return np.ascontiguousarray(out.T)


def packed_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of some ids, side by side, and where each begins; the last is filled up with its own last id."""
    if not len(ids):
        return b"", np.zeros(0, dtype=np.int64)
    padded = np.concatenate((ids, np.full(-len(ids) % BLOCK, ids[-1], dtype=ids.dtype)))
    rows = padded.reshape(-1, BLOCK).astype(np.uint32)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    lengths = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    place = int(PERCENTILE * (BLOCK - 1))
    widths = np.partition(lengths, place, axis=1)[:, place]
    wide = lengths > widths[:, None]
    heads = np.zeros(len(rows), dtype=_HEAD)
    heads["least"], heads["width"], heads["exceptions"] = least, widths, wide.sum(axis=1)
    many = heads["exceptions"].astype(np.int64)
    after = _HEAD.itemsize + 8 * _words(widths.astype(np.int64))  # from a block's start to its exceptions
    sizes = after + (_POSITION.itemsize + _WHOLE.itemsize) * many
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    _scatter(out, starts, heads)
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        packed = pack_bits(rest[chosen] & np.uint32((1 << int(width)) - 1), int(width)).view(np.uint8)
        for at, words in zip((starts[chosen] + _HEAD.itemsize).tolist(), packed, strict=True):
            out[at : at + len(words)] = words
    row, at = np.nonzero(wide)
    positions, wholes = _exceptions(starts + after, many)
    _scatter(out, positions, at.astype(_POSITION))
    _scatter(out, wholes, rest[row, at].astype(_WHOLE))
    return out.tobytes(), starts


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of some ids one by one."""
    data, starts = packed_blocks(ids)
    bounds = [*starts.tolist(), len(data)]
    return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _scatter(out: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
    """The bytes of each value from its place on."""
    parts = values.view(np.uint8).reshape(len(values), values.itemsize)
    for byte in range(values.itemsize):
        out[places + byte] = parts[:, byte]


def _gather(data: np.ndarray, places: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The values that begin at the places."""
    parts = np.empty((len(places), kind.itemsize), dtype=np.uint8)
    for byte in range(kind.itemsize):
        parts[:, byte] = data[places + byte]
    return parts.reshape(-1).view(kind)


def _exceptions(begins: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the position and the whole difference of every exception lie; a block's lists begin at ``begins``."""
    order = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begins, ends = np.repeat(begins, many), np.repeat(begins + _POSITION.itemsize * many, many)
    return begins + _POSITION.itemsize * order, ends + _WHOLE.itemsize * order


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data`` (whole blocks, fill included)."""
    told = np.frombuffer(data, dtype=np.uint8)
    heads = _gather(told, starts, _HEAD)
    rest = np.zeros((len(starts), BLOCK), dtype=np.uint32)
    for width in np.unique(heads["width"]):
        chosen = np.flatnonzero(heads["width"] == width)
        size = 8 * _words(int(width))
        words = b"".join([data[at : at + size] for at in (starts[chosen] + _HEAD.itemsize).tolist()])
        rest[chosen] = unpack_bits(np.frombuffer(words, "<u8").reshape(len(chosen), -1 if size else 0), int(width))
    many = heads["exceptions"].astype(np.int64)
    positions, wholes = _exceptions(starts + _HEAD.itemsize + 8 * _words(heads["width"].astype(np.int64)), many)
    rest[np.repeat(np.arange(len(starts)), many), _gather(told, positions, _POSITION)] = _gather(told, wholes, _WHOLE)
    return (rest + heads["least"][:, None]).astype("<u4").reshape(-1)


class Writer:
    def __init__(self, out):
        self.out, self.size = out, len(MAGIC)
        out.write(MAGIC)
        self.waiting: list[bytes] = []
        self.held = self.ids = 0
        self.starts: list[np.ndarray] = []
        self.documents: list[int | None] = []
        self.firsts: list[int] = []

    def add(self, document: int | None, ids: bytes) -> None:
        self.documents.append(document)
        self.firsts.append(self.ids)
        self.ids += len(ids) // 4
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * SEGMENT:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.waiting)
        whole = len(data) if last else len(data) // (4 * BLOCK) * (4 * BLOCK)
        ids = np.frombuffer(data[:whole], dtype="<u4")
        for at in range(0, len(ids), SEGMENT):
            blocks, starts = packed_blocks(ids[at : at + SEGMENT])
            self.starts.append(starts + self.size)
            self.out.write(blocks)
            self.size += len(blocks)
        self.waiting, self.held = [data[whole:]], len(data) - whole

    def close(self) -> None:
        self._flush(True)
        known = np.array([d is not None for d in self.documents], dtype=np.uint8)
        numbers = np.array([d or 0 for d in self.documents], dtype="<i8")
        starts = np.concatenate([np.zeros(0, "<u8"), *self.starts]).astype("<u8")
        parts = (starts, known, numbers, np.array(self.firsts, "<u8"))
        footer = struct.pack("<QQQ", self.ids, len(starts), len(numbers)) + b"".join(p.tobytes() for p in parts)
        footer = zlib.compress(footer)
        self.out.write(footer + struct.pack("<Q", len(footer)))
        self.size += len(footer) + 8
        self.out.close()


def read_file(source) -> Iterator[tuple[int | None, int, bytes]]:
    """(document, first token in the file, ids) of a random-access file, in order."""
    source.seek(0)
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("no token file")
    size = source.size()
    source.seek(size - 8)
    length = struct.unpack("<Q", source.read(8))[0]
    source.seek(size - 8 - length)
    footer = zlib.decompress(source.read(length))
    total, n_blocks, n_docs = struct.unpack_from("<QQQ", footer)
    starts = np.frombuffer(footer, "<u8", n_blocks, 24).astype(np.int64)
    known = np.frombuffer(footer, "u1", n_docs, 24 + 8 * n_blocks)
    numbers = np.frombuffer(footer, "<i8", n_docs, 24 + 8 * n_blocks + n_docs)
    firsts = np.frombuffer(footer, "<u8", n_docs, 24 + 8 * n_blocks + 9 * n_docs).astype(np.int64)
    ends = np.append(starts[1:], size - 8 - length)
    held, at, block = b"", 0, 0  # decoded ids, of which those from byte ``at`` on are not yet given out
    step = SEGMENT // BLOCK
    wanted = 4 * np.diff(np.append(firsts, total))
    for document, some, first, size in zip(numbers.tolist(), known.tolist(), firsts.tolist(), wanted.tolist(), strict=True):
        if len(held) - at < size:
            parts, have = [held[at:]], len(held) - at
            while have < size:
                blocks = slice(block, min(block + step, n_blocks))
                source.seek(int(starts[blocks][0]))
                data = source.read(int(ends[blocks][-1] - starts[blocks][0]))
                parts.append(decode_blocks(data, starts[blocks] - starts[blocks][0]).tobytes())
                have += len(parts[-1])
                block = blocks.stop
            held, at = b"".join(parts), 0
        yield (document if some else None), first, held[at : at + size]
        at += size


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int) -> Iterator[pa.RecordBatch]:
    store, base = opened(folder)
    store.create_dir(base, recursive=True)
    part = TaskContext.get().partitionId()
    name = f"part-{part:06d}-{uuid4().hex}.ids"
    using, last, writer = encoder(path), struct.pack("<I", end), None
    for batch in batches:
        for document, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            writer = writer or Writer(store.open_output_stream(f"{base}/{name}", compression=None))
            writer.add(document, using.ids(text or "") + last)
    if writer:
        writer.close()
        row = {"part": part, "path": f"{folder}/{name}", "documents": len(writer.documents), "ids": writer.ids, "bytes": writer.size}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for path, base, *told in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            seen = [0, 0]
            store, name = opened(path)
            with store.open_input_file(name) as source:
                rows, size = [], 0
                for document, first, ids in read_file(source):
                    rows.append((document, base + first, ids))
                    seen = [seen[0] + 1, seen[1] + len(ids) // 4]
                    size += len(ids)
                    if len(rows) == 512 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            if seen != told:
                raise ValueError(f"{path}: {seen} documents and ids, its manifest says {told}")


def write_token_files(docs: DataFrame, folder: str, path: str, end: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text, append ``end``, write the files below ``folder`` and return the written manifest.

    A NULL text is empty and gives ``end`` alone. Ids ascend with NULL first; rows of equal ids stand side by
    side, ordered by a hash of their text. ``path`` is a byte-level BPE file that every executor can read. A
    folder that tasks cannot open raises ValueError.
    """
    reachable(folder)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie)
    ordered.mapInArrow(partial(_write, folder=f"{folder}/files", path=path, end=end), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document of the files: id, ``start`` (ids of all documents before it) and ``ids`` (binary, 32-bit
    little-endian). The manifest has one row a file, so its running sum is small. A file that is cut or
    emptied, or holds other numbers of documents and ids than its manifest says, raises."""
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).cast("bigint").alias("base"), "documents", "ids")
    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(_read, "id bigint, start bigint, ids binary").withColumnRenamed("id", id_column)


def token_round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return read_token_files(write_token_files(docs, work_folder(spark, "token-files"), path))
