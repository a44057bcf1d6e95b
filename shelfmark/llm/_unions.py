"""Connected components of a link table, by rounds of large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm._joins import split_join

EDGES = "a bigint, b bigint"
BATCH = 1 << 20


def _forest(links: Iterator[tuple[int, int]]) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = parent[min(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task, at most BATCH at a time, as stars around each part's least node."""
    held: list[tuple[int, int]] = []

    def stars() -> pa.RecordBatch:
        pairs = [(x, top) for x, top in _forest(iter(held)).items() if x != top]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"]
        )

    for batch in batches:
        held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(held) >= BATCH:
            yield stars()
    if held:
        yield stars()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return split_join(both, least, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = split_join(down, least, ["a"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(a, b): every node that is not the least of its component, with that least node.

    ``links`` has two bigint columns. Each round is written below ``folder``, so a lost executor
    costs no earlier round. Hubs are no problem: neighbours are only ever reduced to a minimum.
    """
    spark = links.sparkSession
    current, before = links.toDF("a", "b").mapInArrow(_contract, EDGES), None
    for turn in range(100):
        path = f"{folder}/round-{turn}"
        current.write.parquet(path)
        written = spark.read.schema(EDGES).parquet(path)
        state = written.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return written
        before, current = state, _small_star(_large_star(written))
    raise RuntimeError("components did not settle")
