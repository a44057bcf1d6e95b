"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidates.

Method. One hash permutes a text's shingles; its range is cut into ``BINS`` bins and each bin keeps
its least value. Empty bins borrow from other bins in an order that depends on the bin alone
(optimal densification). ``ROWS`` bins make a band, a band's values a bucket. In each bucket one
member is the centre and every other is compared with it alone, on full shingle sets, so a bucket
of n gives n - 1 pairs. Centres are chosen by a hash of bucket and member: a member meets
another centre in every band.

A star can miss a link between two members that both differ from their centre. So after the stars
are joined to components, a bucket whose other members still lie in several components is
searched whole: members outside its largest component against all, in blocks of bounded size, counted
by matrix products inside a task; only one link for each text and component leaves the task.
There is no cap on buckets, partners or candidates.

At similarity 0.8 a pair shares no bucket with a chance of 3e-6, less for closer pairs.
Texts with equal shingle sets are one node throughout. Node numbers have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm._joins import split_join
from shelfmark.llm._unions import components
from shelfmark.llm._words import distinct, mix, shingle_sets
from shelfmark.session import work_folder

BINS, ROWS = 256, 6
BANDS = BINS // ROWS
BLOCK = 256  # texts of a bucket compared at once
BLOCK_SHINGLES = 1 << 21
COLUMNS = 1 << 13
WORDS, PERCENT = 5, 80

# Where an empty bin looks for a value: at every try another bin, the same for all texts.
_TRIES = 64
_WALK = (
    mix(np.arange(_TRIES * BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)) % np.uint64(BINS)
).reshape(_TRIES, BINS).astype(np.int64)


def _node(shingles: np.ndarray) -> int:
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def _dense(least: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row (rows without any full bin stay as they are)."""
    out, open_ = least.copy(), ~full & full.any(axis=1)[:, None]
    for walk in _WALK:
        if not open_.any():
            return out
        use = open_ & full[:, walk]
        out[use] = least[:, walk][use]
        open_ &= ~use
    for step in range(1, BINS):  # very few full bins: the next full one to the right
        use = open_ & np.roll(full, -step, axis=1)
        out[use] = np.roll(least, -step, axis=1)[use]
        open_ &= ~use
    return out


def band_numbers(sets: list[np.ndarray]) -> np.ndarray:
    """The bucket of every band (columns) of every shingle set (rows)."""
    least = np.zeros((len(sets), BINS), dtype=np.uint64)
    full = np.zeros((len(sets), BINS), dtype=bool)
    for row, shingles in enumerate(sets):
        if len(shingles):
            bins = (shingles >> np.uint64(56)).astype(np.int64)  # ascending, so a bin's first is its least
            first = np.concatenate(([0], np.flatnonzero(np.diff(bins)) + 1))
            least[row, bins[first]] = shingles[first]
            full[row, bins[first]] = True
    least = _dense(least, full)
    bands = mix(np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS)).copy())
    for row in range(ROWS):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + least[:, row : BANDS * ROWS : ROWS])
    return bands


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    column = batch.column(batch.schema.names.index("text")).cast(pa.binary())
    return [(text or b"").lower() for text in column.to_pylist()]


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(_texts(batch), words))
        bands = band_numbers(sets)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_node(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64))
                ),
            ],
            ["id", "n_shingles", "node", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(_texts(batch), words))
        lengths = np.cumsum([0] + [len(s) for s in sets], dtype=np.int32)
        values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([_node(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(lengths), pa.array(values.view(np.int64))),
            ],
            ["node", "shingles"],
        )


def _shared(sets: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Shingles that each left text shares with each text, by products of 0/1 matrices."""
    values = distinct(np.concatenate(sets))
    columns = [np.searchsorted(values, s) for s in sets]
    counts = np.zeros((len(left), len(sets)), dtype=np.float64)
    for at in range(0, len(values), COLUMNS):
        marks = np.zeros((len(sets), min(COLUMNS, len(values) - at)), dtype=np.float32)
        for row, places in enumerate(columns):
            marks[row, places[np.searchsorted(places, at) : np.searchsorted(places, at + COLUMNS)] - at] = 1
        counts += marks[left] @ marks.T
    return counts


def _compare(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    nodes, parts, lefts, sets = zip(*rows, strict=True)
    left = np.flatnonzero(np.array(lefts))
    if not len(left):
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    shared = _shared(list(sets), left)
    linked = 100 * shared >= percent * (sizes[left][:, None] + sizes[None, :] - shared)
    found = []
    for i, row in zip(left, linked, strict=True):
        others = {parts[j]: nodes[j] for j in np.flatnonzero(row) if parts[j] != parts[i]}
        found += [(nodes[i], node) for node in others.values()]
    return found


def _search(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links inside blocks; a block's rows follow each other."""
    held: list[tuple] = []
    key = None
    found: list[tuple[int, int]] = []

    def links() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"]
        )
        found.clear()
        return out

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        rest = zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
        lists = batch.column(6)
        bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        for i, (block, row) in enumerate(zip(keys, rest, strict=True)):
            if block != key:
                if held:
                    found += _compare(held, percent)
                held, key = [], block
            held.append((*row, values[bounds[i] : bounds[i + 1]].copy()))
        if found:
            yield links()
    if held:
        found += _compare(held, percent)
    if found:
        yield links()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter((100 * small >= percent * large) & (100 * shared >= percent * (small + large - shared))).select("a", "b")


def _blocks(entries: DataFrame) -> DataFrame:
    """Deal the members of buckets with several components out to blocks of bounded size.

    Members outside a bucket's largest component stand on the left of a block, all on the right.
    """
    parts = entries.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    buckets = (
        parts.groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("part", F.struct("n", "part")).alias("main"), F.max("size").alias("size"))
        .filter("n > most")
        .withColumn("rows", F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(BLOCK_SHINGLES / F.col("size")))))
        .select(
            "bucket", "main",
            F.ceil((F.col("n") - F.col("most")) / F.col("rows")).alias("lefts"), F.ceil(F.col("n") / F.col("rows")).alias("rights"),
        )
    )
    members = split_join(entries, buckets, ["bucket"])
    by_node = F.xxhash64("node", F.lit(5))
    left = members.filter("part <> main").select(
        "bucket", F.pmod(by_node, "lefts").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rights") - 1)).alias("j"),
        "node", "part", F.lit(True).alias("is_left"),
    )
    right = members.select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lefts") - 1)).alias("i"), F.pmod(by_node, "rights").alias("j"),
        "node", "part", F.lit(False).alias("is_left"),
    )
    return left.union(right)


def near_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``kept``.

    Words are lower-cased in A-Z only. Documents are linked if 100 * |A and B| >= percent * |A or B| for their
    sets of distinct shingles; ``component_id`` is the least id that links lead to, ``kept`` marks it.

    NULL and empty texts, and texts without words, have no shingles and are linked with nothing; fewer
    words than a shingle has are one shingle. Rows with a NULL id are linked with nothing, have a NULL component and are
    kept. Rows with the same id are separate rows with one component if their texts agree. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "near-dedup")
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = texts.schema["id"].dataType
    signed_schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("node", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )
    texts.mapInArrow(partial(_sign, words=words), signed_schema).write.parquet(f"{folder}/signatures")
    signed = spark.read.schema(signed_schema).parquet(f"{folder}/signatures")
    linkable = signed.filter("id IS NOT NULL AND n_shingles > 0")
    distinct_nodes = linkable.groupBy("node").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("size"), F.first("bands").alias("bands"))
    distinct_nodes.write.parquet(f"{folder}/nodes")
    nodes = spark.read.schema(distinct_nodes.schema).parquet(f"{folder}/nodes")

    # Buckets of two nodes or more; copies are one node, so equal texts fill no bucket.
    entries = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    centre = F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node"))
    buckets = (
        entries.groupBy("bucket")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), centre.alias("c"))
        .filter("low <> high")
        .select("bucket", F.col("c.node").alias("centre"))
    )
    split_join(entries, buckets, ["bucket"]).filter("node <> centre").select("node", "size", "bucket", "centre").write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")  # node, size, bucket, centre

    pairs = members.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    wanted = members.select("node").union(members.select("centre")).distinct()
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("rep").alias("id")).distinct()
    (
        texts.join(ids, "id", "left_semi")
        .mapInArrow(partial(_sets, words=words), "node bigint, shingles array<bigint>")
        .dropDuplicates(["node"])
        .write.parquet(f"{folder}/sets")
    )
    sets = spark.read.parquet(f"{folder}/sets")

    links = _confirmed(pairs, sets, percent)
    stars = components(links, f"{folder}/stars")
    labels = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    open_entries = members.join(labels, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("part"))
    (
        _blocks(open_entries)
        .join(sets, "node")
        .select("bucket", "i", "j", "node", "part", "is_left", "shingles")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(partial(_search, percent=percent), "a bigint, b bigint")
        .write.parquet(f"{folder}/rest")
    )
    rest = spark.read.parquet(f"{folder}/rest")
    joined = stars if rest.isEmpty() else components(stars.union(rest), f"{folder}/all")

    labels = joined.select(F.col("a").alias("node"), F.col("b").alias("root"))
    rooted = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = split_join(rooted, least, ["root"]).select("node", "component_id")
    known = signed.select("id", "n_shingles", "node").join(classes, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return known.select(
        F.col("id").alias(id_column),
        "n_shingles",
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, without near duplicates: of each component the least id stays.

    Rows that repeat a kept id and its component count as one document; one of them stays. Rows without words or id stay.
    """
    spark, names = docs.sparkSession, docs.columns
    folder = work_folder(spark, "near-dedup")
    near_components(docs, words, percent, id_column, text_column).write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")
    gone = found.filter(~F.col("kept")).select(F.col(id_column).alias("near_dedup_id")).distinct()
    stays = docs.join(gone, docs[id_column] == gone["near_dedup_id"], "left_anti")
    twice = found.filter(F.col("kept") & (F.col("n_shingles") > 0)).groupBy(F.col(id_column).alias("near_dedup_id")).count().filter("count > 1").select("near_dedup_id")
    if twice.isEmpty():
        return stays.select(*names)
    single = stays.join(twice, stays[id_column] == twice["near_dedup_id"], "left_anti")
    repeated = stays.join(twice, stays[id_column] == twice["near_dedup_id"], "left_semi").dropDuplicates([id_column])
    return single.select(*names).union(repeated.select(*names))
