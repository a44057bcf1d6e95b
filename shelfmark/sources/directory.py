"""A directory of snapshot pairs as a data source that also sees empty files.

Spark's file sources leave out files of zero bytes, but an empty page is a page. This source lists the directory
once, when the read is planned, and deals the keys (with what files they have, not their contents) to partitions
of about ``files_per_partition`` files; tasks open the files. The listing is as long as the directory: names and sizes, as for any file source.

The folder must be of a kind that ``pyarrow.fs`` opens on driver and executors: local or mounted, HDFS, S3, GCS.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# File name shapes of a snapshot directory (64 hex digits).
_FILE = re.compile(r"([0-9a-f]{64})\.(html|meta\.json)")
SHAPE = "url_key string, html string, meta string"
FILES = 1000


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme in ("s3a", "s3n"):
        path = f"s3:{rest}"
    if re.match(r"[a-z][a-z0-9+.-]*:/", path):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class _Keys(InputPartition):
    def __init__(self, entries: list[tuple[str, bool, bool]]):
        super().__init__(None)
        self.entries = entries  # key, has a page, has meta data


class _Reader(DataSourceReader):
    def __init__(self, path: str, files: int):
        self.path, self.files = path, files

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, folder = opened(self.path)
        found: dict[str, set[str]] = {}
        for info in system.get_file_info(fs.FileSelector(folder)):
            match = _FILE.fullmatch(info.base_name)
            if match and info.type == fs.FileType.File:
                found.setdefault(match[1], set()).add(match[2])
        entries = [(key, "html" in kinds, "meta.json" in kinds) for key, kinds in sorted(found.items())]
        step = max(1, self.files // 2)
        return [_Keys(entries[i : i + step]) for i in range(0, len(entries), step)] or [_Keys([])]

    def read(self, partition: _Keys) -> Iterator[tuple]:
        system, folder = opened(self.path)

        def text(name: str) -> str:
            with system.open_input_stream(f"{folder.rstrip('/')}/{name}") as stream:
                return stream.read().decode("utf-8", "replace")

        for key, page, meta in partition.entries:
            yield key, text(f"{key}.html") if page else None, text(f"{key}.meta.json") if meta else None


class SnapshotDirectory(DataSource):
    """``url_key``, ``html`` and ``meta`` (the text of the meta file) of every key; NULL where that file is missing."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_directory"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("files_per_partition", FILES)))


def read_directory(spark: SparkSession, path: str, files_per_partition: int = FILES) -> DataFrame:
    spark.dataSource.register(SnapshotDirectory)
    return spark.read.format(SnapshotDirectory.name()).option("files_per_partition", files_per_partition).load(path)


# Names told at once, and bytes of pages read at once.
_NAMES, _BYTES = 10_000, 8 << 20


def _names(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Names of the pages and meta files of a folder that are not empty."""
    from pyarrow import fs

    system, folder = opened(path)

    def found() -> Iterator[str]:
        if isinstance(system, fs.LocalFileSystem):
            with os.scandir(folder) as entries:
                yield from (entry.name for entry in entries if _FILE.fullmatch(entry.name) and entry.is_file() and entry.stat().st_size)
        else:
            infos = system.get_file_info(fs.FileSelector(folder))
            yield from (info.base_name for info in infos if _FILE.fullmatch(info.base_name) and info.type == fs.FileType.File and info.size)

    for _ in batches:
        names = found()
        while some := list(islice(names, _NAMES)):
            yield pa.RecordBatch.from_pydict({"name": some})


def _pages(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The files of keys (url_key, page, meta), some at a time."""
    system, folder = opened(path)
    rows, size = [], 0

    def content(name: str) -> bytes:
        with system.open_input_stream(f"{folder.rstrip('/')}/{name}") as stream:
            return stream.read()

    def batch() -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.binary()))], names=["url_key", "html", "meta"])

    for key, page, meta in (row for some in batches for row in zip(*(c.to_pylist() for c in some.columns), strict=True)):
        rows.append((key, content(f"{key}.html") if page else None, content(f"{key}.meta.json") if meta else None))
        size += sum(len(text) for text in rows[-1][1:] if text)
        if size > _BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def is_directory(path: str) -> bool:
    """Whether ``pyarrow.fs`` opens a path and finds a folder there."""
    from pyarrow import fs

    try:
        system, folder = opened(path)
        return system.get_file_info(folder).type == fs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):
        return False


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``url_key``, ``html`` and ``meta`` of every key, without files of zero bytes; NULL where a file is missing.

    One task lists the folder and passes the names on as it sees them, names are dealt to tasks by their key, and tasks open the files of their
    keys. So the driver holds no name, and what meets are names, not pages."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = spark.range(0, 1, 1, 1).mapInArrow(partial(_names, path=path), "name string")
    page = F.endswith("name", F.lit(".html"))
    keys = names.select(F.substring("name", 1, 64).alias("url_key"), page.alias("page")).repartition(tasks, "url_key")
    pairs = keys.groupBy("url_key").agg(F.bool_or("page").alias("page"), F.bool_or(~F.col("page")).alias("meta"))
    files = pairs.mapInArrow(partial(_pages, path=path), "url_key string, html binary, meta binary")
    return files.select("url_key", *(F.make_valid_utf8(F.col(name).cast("string")).alias(name) for name in ("html", "meta")))
