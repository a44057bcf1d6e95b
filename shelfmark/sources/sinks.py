"""Writers.  Spark's commit protocol makes each write whole or absent; :func:`write_product_files` says what holds for it."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.urls import output_key
from shelfmark.schemas import PROCESSED
from shelfmark.sources.directory import opened


def stamped(products: DataFrame, run_at: Column) -> DataFrame:
    """Sets the missing ``scraped_at`` to one run time, so that writing again gives the same rows."""
    return products.withColumn("scraped_at", F.coalesce("scraped_at", run_at))


def to_json(table: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text; absent values stay as nulls, times are ISO with their zone."""
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return table.select(F.to_json(F.struct("*"), options).alias(name))


def write_json(table: DataFrame, path: str) -> None:
    """JSON files, one record per line."""
    table.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_product_files(products: DataFrame, path: str, url: str = "url") -> None:
    """One directory per product, named by its id in the URL, else ``product``.

    There is no shuffle by that name: the rows without an id may be a large part of
    the table, and each task writes its own file of them.

    The tasks write through ``pyarrow.fs``: a file system call or two a product, and nothing for the driver to move.  So a
    write that fails leaves some files behind, without the mark of a whole one that
    :func:`read_product_files` asks for; writing again replaces them.  Which files there are is kept as a table beside
    them (``_written``), so that no reader has to list a folder a product.
    """
    system, folder = opened(path)
    if system.get_file_info(folder).type == FileType.Directory:
        system.delete_dir_contents(folder)
    system.create_dir(folder, recursive=True)
    line = F.to_json(F.struct(*products.columns), {"ignoreNullFields": "false"}).alias("line")
    keyed = products.select(output_key(F.col(url)).alias("key"), line).sortWithinPartitions("key")
    keyed.mapInArrow(partial(_write_keys, path=path), _WRITTEN).write.parquet(f"{path.rstrip('/')}/_written")
    with system.open_output_stream(f"{folder.rstrip('/')}/_SUCCESS"):
        pass


# Key and name of each file.
_WRITTEN = "output_key string, name string"
# Files told of at once, and bytes of the lines read at once.
_FILES, _BYTES = 10_000, 4 << 20


def _write_keys(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Lines (key, line), in the order of their keys, to a file a key; a task that is run again writes the same names."""
    system, folder = opened(path)
    name = f"part-{TaskContext.get().partitionId():05d}.json"
    rows = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

    def written() -> Iterator[str]:
        for key, lines in groupby(rows, key=itemgetter(0)):
            place = f"{folder.rstrip('/')}/output_key={key}"
            system.create_dir(place)
            with system.open_output_stream(f"{place}/{name}") as out:
                for _, line in lines:
                    out.write(f"{line}\n".encode())
            yield key

    keys = written()
    while some := list(islice(keys, _FILES)):
        yield pa.RecordBatch.from_pydict({"output_key": some, "name": [name] * len(some)})


def read_product_files(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What :func:`write_product_files` wrote, if it was written whole; ``schema`` may name ``output_key`` too.

    Tasks open the files that the writer's table names, so the driver holds no list of them."""
    system, folder = opened(path)
    if system.get_file_info(f"{folder.rstrip('/')}/_SUCCESS").type != FileType.File:
        raise ValueError(f"the product files in {path!r} are not whole")
    if system.get_file_info(f"{folder.rstrip('/')}/_written").type != FileType.Directory:
        return spark.read.schema(schema).json(path)  # of a writer that kept no table
    fields = spark.createDataFrame([], schema).schema.fields
    kind = next((field.dataType for field in fields if field.name == "output_key"), T.StringType())
    told = T.StructType([field for field in fields if field.name != "output_key"])
    files = spark.read.schema(_WRITTEN).parquet(f"{path.rstrip('/')}/_written")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lines = files.repartition(tasks, "output_key", "name").mapInArrow(partial(_read_keys, path=path), "output_key string, line string")
    key = F.col("output_key").cast(kind).alias("output_key")
    if not told.fields:
        return lines.select(key)
    return lines.select(F.from_json("line", told).alias("told"), key).select("told.*", "output_key")


def _read_keys(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The lines of files (key, name), some at a time."""
    system, folder = opened(path)
    keys, lines, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], names=["output_key", "line"])

    for key, name in (pair for some in batches for pair in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)):
        with system.open_input_stream(f"{folder.rstrip('/')}/output_key={key}/{name}") as stream:
            for line in io.TextIOWrapper(stream, "utf-8", newline="\n"):
                keys.append(key)
                lines.append(line)
                size += len(line)
                if size > _BYTES or len(lines) == _FILES:
                    yield batch()
                    keys, lines, size = [], [], 0
    if lines:
        yield batch()


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Adds captures; the newest one of a key counts when read, so nothing is rewritten."""
    snapshots.withColumn("cached_on", F.to_date("cached_at")).write.mode("append").partitionBy("cached_on").parquet(path)


def append_processed(urls: DataFrame, path: str, at: Column) -> None:
    urls.select("url", at.cast("timestamp").alias("processed_at")).write.mode("append").parquet(path)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROCESSED).parquet(path)
