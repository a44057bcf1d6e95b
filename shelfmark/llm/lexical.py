"""Ranked lexical search with a document FP-tree and branch-and-bound.

One pass over the texts cuts every text into terms and keeps, of the terms that some item asks for, how often the text holds
them (a restricted vector), and its number of all terms. Sums over that narrow table give document frequencies and the
average length. Then tasks take documents in blocks. A block's vectors, with terms in the order of falling document
frequency, are a trie: documents that begin with the same frequent terms share a path. A trie node knows, for its subtree, the greatest tf of
every term and the least m (length norm), which bound the score of any document below it. An item goes down the
trie depth first, to the child with the greatest bound first, and leaves out subtrees whose bound is below its worst kept score;
leaves of up to ``LEAF`` documents are scored exactly, in whole numbers. What an item has found carries over to the task's next
block. A task gives ``k`` documents an item, so the last ranking reads that many rows a task and item.

Items are taken in groups of about ``ITEMS`` by a hash of their id, each with a pass of its own over the texts, so that the terms a task
holds and the driver sends are bounded by the texts of a group.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.session import work_folder

ITEMS = 1024
SLICE = 256  # items whose bounds are taken at once
CELLS = 1 << 22  # numbers in a table of bounds
BLOCK, ENTRIES = 4096, 1 << 20  # documents, or terms of documents, in a trie
LEAF = 32

# A-Z to a-z, other ASCII signs but digits to spaces; bytes of characters beyond ASCII stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms(text))) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])


def _restricter(vocabulary: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    number = {term: i for i, term in enumerate(vocabulary)}

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, which, often = [], [], []
            for value in batch.column(1):
                found = terms(value.as_py())
                lengths.append(len(found))
                held = np.array([i for i in map(number.get, found) if i is not None], dtype=np.int32)
                some, counts = np.unique(held, return_counts=True)
                which.append(some)
                often.append(counts.astype(np.int32))
            arrays = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "terms", "tfs"])

    return restrict


class _Tree:
    """The trie of a block. Documents lie in the order of their vectors; a node covers documents ``low`` to ``high``."""

    def __init__(self, ids: list, m: np.ndarray, starts: np.ndarray, ranks: np.ndarray, tfs: np.ndarray):
        keys = [ranks[a:b].astype(">u4").tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        sizes = np.diff(starts)[order]
        self.keys = [keys[i] for i in order]
        self.ids = [ids[i] for i in order]
        self.m = m[order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(starts[:-1][order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.ranks, self.tfs = ranks[at], tfs[at].astype(np.int64)
        self.parts = self.tfs * 1_000_000_000 // (1000 * self.tfs + 8 * np.repeat(self.m, sizes))
        self.low: list[int] = []
        self.high: list[int] = []
        self.children: list[list[int]] = []
        self._grow()
        self._summarise()

    def _node(self, low: int, high: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        return len(self.low) - 1

    def _grow(self) -> None:
        keys, open_ = self.keys, [self._node(0, len(self.keys))]
        while open_:
            node = open_.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            first, last = keys[low], keys[high - 1]
            if first == last:  # one path: equal vectors
                cuts = list(range(low, high, LEAF)) + [high]
            else:
                shared = next((i for i in range(0, len(first), 4) if first[i : i + 4] != last[i : i + 4]), len(first))
                cuts = [low]
                for i in range(low + 1, high):
                    if keys[i][shared : shared + 4] != keys[i - 1][shared : shared + 4]:
                        cuts.append(i)
                cuts.append(high)
                # Small neighbours share a leaf.
                merged = [low]
                for here, after in zip(cuts[1:-1], cuts[2:], strict=True):
                    if after - merged[-1] > LEAF:
                        merged.append(here)
                cuts = [*merged, high]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                child = self._node(start, end)
                self.children[node].append(child)
                open_.append(child)

    def _summarise(self) -> None:
        """Each node's terms with their greatest tf, and its least m."""
        count = len(self.low)
        self.held: list[np.ndarray] = [None] * count
        self.most: list[np.ndarray] = [None] * count
        self.least_m = np.zeros(count, dtype=np.int64)
        for node in reversed(range(count)):  # children have higher numbers
            if self.children[node]:
                ranks = np.concatenate([self.held[c] for c in self.children[node]])
                tfs = np.concatenate([self.most[c] for c in self.children[node]])
            else:
                a, b = self.starts[self.low[node]], self.starts[self.high[node]]
                ranks, tfs = self.ranks[a:b], self.tfs[a:b]
            order = np.argsort(ranks, kind="stable")
            ranks, tfs = ranks[order], tfs[order]
            heads = np.concatenate([[0], np.nonzero(np.diff(ranks))[0] + 1])
            self.held[node], self.most[node] = ranks[heads], np.maximum.reduceat(tfs, heads)
            self.least_m[node] = self.m[self.low[node] : self.high[node]].min()

    def bounds(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(nodes, items): no document below a node scores more for an item."""
        out = np.empty((len(self.low), weights.shape[1]))
        step = max(1, CELLS // max(1, len(weights)))
        for start in range(0, len(out), step):
            nodes = range(start, min(start + step, len(out)))
            values = np.zeros((len(nodes), len(weights)))
            for row, node in enumerate(nodes):
                at = columns[self.held[node]]
                inside = at >= 0
                tf = self.most[node][inside]
                values[row, at[inside]] = tf * 1_000_000_000 // (1000 * tf + 8 * self.least_m[node])
            out[start : start + len(nodes)] = values @ weights
        return out * (1 + 1e-9)

    def search(self, bound: np.ndarray, columns: np.ndarray, weights: np.ndarray, best: list, k: int) -> None:
        """Puts documents that are among the ``k`` best into ``best``, a sorted list of (-score, no id, id)."""
        open_ = [0]
        while open_:
            node = open_.pop()
            if bound[node] <= 0 or len(best) == k and bound[node] < -best[-1][0]:
                continue
            if self.children[node]:
                open_.extend(sorted(self.children[node], key=bound.__getitem__))
                continue
            low, high = self.low[node], self.high[node]
            a, b = self.starts[low], self.starts[high]
            scores = np.add.reduceat(weights[columns[a:b]] * self.parts[a:b], self.starts[low:high] - a)
            for i in np.nonzero(scores >= (-best[-1][0] if len(best) == k else 1))[0]:
                identity = self.ids[low + i]
                entry = (-int(scores[i]), identity is None, identity if identity is not None else 0)
                if len(best) < k or entry < best[-1]:
                    insort(best, entry)
                    del best[k:]


def _searcher(items: list[tuple[object, np.ndarray, np.ndarray]], rank_of: np.ndarray, n_docs: int, n_terms: int, k: int, id_type, item_type) -> Callable:
    """``items``: (id, ranks of its terms, their weights); ``rank_of``: a term's rank by falling document frequency."""
    slices = [items[i : i + SLICE] for i in range(0, len(items), SLICE)]
    tables = []
    for part in slices:
        asked = np.unique(np.concatenate([ranks for _, ranks, _ in part]))
        columns = np.full(len(rank_of) + 1, -1, dtype=np.int64)
        columns[asked] = np.arange(len(asked))
        weights = np.zeros((len(asked) + 1, len(part)), dtype=np.int64)  # the last row is for terms that none of the slice asks for
        for i, (_, ranks, ws) in enumerate(part):
            weights[columns[ranks], i] = ws
        tables.append((columns, weights))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Tree]:
        ids, ns, counts, which, often = [], [], [], [], []

        def tree() -> _Tree:
            sizes = np.concatenate(counts)
            ranks, tfs = rank_of[np.concatenate(which)], np.concatenate(often)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((ranks, doc))
            m = np.array([10 + 90 * n * n_docs // n_terms for n in ns], dtype=np.int64)
            return _Tree(list(ids), m, np.concatenate([[0], np.cumsum(sizes)]), ranks[order], tfs[order])

        entries = 0
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                found, tfs = batch.column(2), batch.column(3)
                sizes = np.diff(found.offsets.to_numpy())
                some = np.nonzero(sizes)[0]
                if not len(some):
                    continue
                ids += batch.column(0).take(pa.array(some)).to_pylist()
                ns += batch.column(1).take(pa.array(some)).to_pylist()
                counts.append(sizes[some])
                which.append(found.flatten().to_numpy(zero_copy_only=False))
                often.append(tfs.flatten().to_numpy(zero_copy_only=False))
                entries += len(which[-1])
                if len(ids) >= BLOCK or entries >= ENTRIES:
                    yield tree()
                    for held in (ids, ns, counts, which, often):
                        held.clear()
                    entries = 0
        if ids:
            yield tree()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[list]] = [[[] for _ in part] for part in slices]
        for tree in blocks(batches):
            for part, (columns, weights), kept in zip(slices, tables, best, strict=True):
                bounds = tree.bounds(columns, weights[:-1].astype(np.float64))
                at = columns[tree.ranks]
                for i in range(len(part)):
                    tree.search(bounds[:, i], at, weights[:, i], kept[i], k)
        rows = [(item[0], None if none else identity, -score) for part, kept in zip(slices, best, strict=True) for item, top in zip(part, kept, strict=True) for score, none, identity in top]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        types = [item_type, id_type, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item", "id", "score"])

    return search


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranked_search(
    docs: DataFrame, items: DataFrame, *, k: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Each item's ``k`` documents with the highest scores above 0: (item, rank, document, score), named by the id columns.

    Equal scores go by ascending document id, NULL last. NULL and empty texts have no terms: such documents count nowhere, such items find nothing. Rows of
    items with one id are one item with the terms of all; rows of documents with one id are documents of their
    own. Empty tables give an empty one. Scores are as follows, for a document of n terms, of N documents with L terms in all:
    the sum over the item's terms of w * (10^9 tf div (1000 tf + 8 m)), m = 10 + (90 n N div L), w = floor(1000 ln((2N + 2) / (2 df + 1))).
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "lexical")
    id_kind, item_kind = docs.schema[id_column].dataType, items.schema[item_column].dataType
    held = T.StructType([T.StructField("item", item_kind), T.StructField("terms", T.ArrayType(T.BinaryType()))])
    cut = items.select(F.col(item_column).alias("item"), F.col(item_text).alias("text")).mapInArrow(_item_terms, held)
    cut.write.parquet(f"{folder}/items")
    cut = spark.read.parquet(f"{folder}/items")
    groups = max(1, -(-cut.count() // ITEMS))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    restricted = T.StructType([T.StructField("id", id_kind), *T.StructType.fromDDL("n bigint, terms array<int>, tfs array<int>").fields])
    schema = T.StructType([T.StructField("item", item_kind), T.StructField("id", id_kind), T.StructField("score", T.LongType())])
    found = spark.createDataFrame([], schema)
    for group in range(groups):
        asked: dict[object, set[bytes]] = {}
        for row in cut.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == group).collect():  # about ITEMS of them
            asked.setdefault(row["item"], set()).update(map(bytes, row["terms"]))
        vocabulary = sorted(set().union(*asked.values()))
        texts.mapInArrow(_restricter(vocabulary), restricted).write.parquet(f"{folder}/{group}")
        vectors = spark.read.parquet(f"{folder}/{group}")
        n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {row["term"]: row["count"] for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        if not df:
            continue
        rank_of = np.zeros(len(vocabulary), dtype=np.int64)
        order = sorted(range(len(vocabulary)), key=lambda t: (-df.get(t, 0), t))
        rank_of[order] = np.arange(len(vocabulary))
        number = {term: i for i, term in enumerate(vocabulary)}
        wanted = []
        for item, words in asked.items():
            known = [number[word] for word in words if df.get(number[word])]
            if known:
                wanted.append((item, rank_of[known], np.array([weight(n_docs, df[t]) for t in known], dtype=np.int64)))
        search = _searcher(wanted, rank_of, n_docs, n_terms, k, to_arrow_type(id_kind), to_arrow_type(item_kind))
        found = found.union(vectors.mapInArrow(search, schema))
    window = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")
