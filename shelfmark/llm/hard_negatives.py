"""Hard negatives by coordinate pruning in length buckets (after LEMP).

Vectors are dealt to buckets of at most ``BUCKET`` rows in the order of label and length; a bucket has a list of
its rows' normalised components, sorted, for every coordinate that is asked for. An anchor that looks for rows with a score
(inner product) of T or more needs a cosine of T / (its length * the bucket's greatest length) there; above 1 it skips the
bucket. Else its ``FOCUS`` largest coordinates each give a range of values that such a row can have:
for angles a = acos of the anchor's component and t = acos of the cosine, cos(a + t) to cos(a - t). The ranges are
cut out of the sorted lists and intersected; what remains is verified by exact inner products. T is raised at
once by the longest rows of the bucket, which are verified first, and for positives by the first bucket of the label.

Anchors are dealt to blocks; a pair of a bucket and a block of which some anchor can have a partner there is one group
of bounded size, dealt out by Spark. A group gives the few best rows of each anchor; the best over all groups are final. So a hot label only
means more buckets. Ranges are widened by more than rounding errors, scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import work_folder

BUCKET = 2048  # rows; a power of two
BLOCK = 1024  # anchors, about
FOCUS = 4
FIRST = 64  # a bucket's longest rows, verified before ranges are cut
PAIRS = 64  # buckets that meet anchors under one key of the join that finds pairs
LONGEST = float(1 << 28)  # a hundred times a score then fits 64 bits
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 62), 1 << 62
SLACK = 1e-7  # angles near 0 and pi are only good to about 1e-8

BANDS = "array<struct<tag:bigint,tag_score:bigint,low:bigint,high:bigint>>"
FOUND = "anchor_id bigint, tag bigint, tag_score bigint, id bigint, score bigint"


def whole_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; NULL if a component is NULL or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _indexed(rows: DataFrame, folder: str) -> DataFrame:
    """(id, label, vector, anchor, dims, length, bucket) as written: rows of a bucket have one number of
    components and follow each other by label and length."""
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    kept = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    kept = kept.withColumn("length", F.sqrt(squares)).where(F.col("length") <= LONGEST)
    least = F.min(F.struct("label", "vector", "anchor", "length"))
    once = kept.groupBy("id").agg(least.alias("row")).select("id", "row.*").withColumn("vector", F.col("vector").cast("array<int>"))
    order = [F.size("vector"), F.col("label"), F.col("length").desc(), F.col("id")]
    dealt = once.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.withColumns({"dims": F.size("vector"), "place": F.monotonically_increasing_id()}).write.parquet(f"{folder}/sorted")
    table = rows.sparkSession.read.parquet(f"{folder}/sorted")
    # Buckets are cut from the whole order, so that their number does not depend on that of the partitions.
    part = F.shiftright("place", 33)
    parts = table.groupBy(part.alias("part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("before"))  # a row for each partition
    table = table.withColumn("part", part).join(starts, "part")
    at = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    table.withColumn("bucket", F.shiftright(at, BUCKET.bit_length() - 1)).drop("part", "before", "place").write.parquet(f"{folder}/rows")
    return rows.sparkSession.read.parquet(f"{folder}/rows")


class _Bucket:
    """A bucket's rows, the longest first, and sorted lists of their normalised components."""

    def __init__(self, table: pa.Table, first: int = FIRST):
        self.first = first
        vectors = _matrix(table)
        lengths = table["length"].to_numpy()
        order = np.argsort(-lengths, kind="stable")
        self.whole = vectors[order]
        self.plain = self.whole.astype(np.float64)
        self.lengths = lengths[order]
        self.ids = table["id"].to_numpy()[order]
        self.labels = table["label"].to_numpy()[order]
        self.unit = np.divide(self.plain, self.lengths[:, None], out=np.zeros_like(self.plain), where=self.lengths[:, None] > 0)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def scores(self, rows, anchor: np.ndarray, length: float) -> np.ndarray:
        if length * self.lengths[0] < EXACT:  # all partial sums are whole numbers that doubles hold
            return (self.plain[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.whole[rows] @ anchor

    def sorted_list(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        if coordinate not in self.lists:
            rows = np.argsort(self.unit[:, coordinate], kind="stable")
            self.lists[coordinate] = (self.unit[rows, coordinate], rows)
        return self.lists[coordinate]

    def candidates(self, anchor: np.ndarray, length: float, least: int) -> np.ndarray | slice:
        """Rows after the first ones that may have a score of ``least`` or more."""
        rest = slice(self.first, None)
        if len(self.ids) <= self.first or least <= 0:
            return rest
        reach = length * self.lengths[self.first]
        if least > reach * (1 + SLACK):
            return slice(0, 0)
        turn = np.arccos(min(1.0, least / reach)) + SLACK
        unit = anchor / length
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        angle = np.arccos(np.clip(unit[focus], -1.0, 1.0))
        low = np.cos(np.minimum(np.pi, angle + turn)) - SLACK
        high = np.cos(np.maximum(0.0, angle - turn)) + SLACK
        ranges = []
        for coordinate, least_value, greatest in zip(focus, low, high, strict=True):
            values, rows = self.sorted_list(coordinate)
            ranges.append((rows, np.searchsorted(values, least_value), np.searchsorted(values, greatest, side="right")))
        rows, start, end = min(ranges, key=lambda r: r[2] - r[1])
        if end - start > 0.8 * len(self.ids):
            return rest
        found = rows[start:end]
        for coordinate, least_value, greatest in zip(focus, low, high, strict=True):
            values = self.unit[found, coordinate]
            found = found[(values >= least_value) & (values <= greatest)]
        return found[found >= self.first]


def _matrix(table: pa.Table) -> np.ndarray:
    vectors = table["vector"].combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    inside = np.nonzero((scores >= low) & (scores <= high))[0]
    return inside[np.lexsort((ids[inside], -scores[inside]))[:k]]


def _searcher(k: int, same_label: bool, first_rows: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function from a bucket's rows and a block's anchors to the ``k`` best rows of each band of an anchor."""

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            bucket = _Bucket(rows, first_rows)
            asked = zip(
                anchors["id"].to_pylist(), anchors["label"].to_pylist(), anchors["length"].to_pylist(), _matrix(anchors), anchors["bands"].to_pylist(), strict=True
            )
            for identity, label, length, vector, bands in asked:
                allowed = bucket.labels == label
                allowed = allowed & (bucket.ids != identity) if same_label else ~allowed
                first = np.nonzero(allowed[:first_rows])[0]
                scores = bucket.scores(first, vector, length)
                lows = []
                for band in bands:
                    best = _best(bucket.ids[first], scores, band["low"], band["high"], k)
                    lows.append(int(scores[best[-1]]) if len(best) == k else band["low"])
                rest = np.arange(len(bucket.ids))[bucket.candidates(vector, length, min(lows))]
                rest = rest[allowed[rest]]
                ids = bucket.ids[np.concatenate([first, rest])]
                scores = np.concatenate([scores, bucket.scores(rest, vector, length)])
                for band, low in zip(bands, lows, strict=True):
                    for i in _best(ids, scores, low, band["high"], k):
                        out.append((identity, band["tag"], band["tag_score"], int(ids[i]), int(scores[i])))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "tag", "tag_score", "id", "score"])

    return search


def _search(rows: DataFrame, anchors: DataFrame, pairs: DataFrame, k: int, same_label: bool) -> DataFrame:
    """The ``k`` best rows of every anchor and band within each pair of bucket and block.

    ``anchors`` (id, label, vector, dims, length, block, bands); ``pairs`` (dims, bucket, longest, block).
    """
    left = rows.join(pairs.select("dims", "bucket", "block"), ["dims", "bucket"]).select("dims", "bucket", "block", "id", "label", "vector", "length")
    reach = F.col("length") * F.col("longest") * (1 + SLACK)
    least = F.array_min(F.transform("bands", lambda b: b["low"]))
    right = anchors.join(pairs, ["dims", "block"]).where(reach >= least).select("dims", "bucket", "block", "id", "label", "vector", "length", "bands")
    keys = ["dims", "bucket", "block"]
    # New names, as both sides come from one table of pairs.
    right = right.withColumns({f"met_{name}": F.col(name) for name in keys}).drop(*keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*(f"met_{name}" for name in keys))).applyInArrow(_searcher(k, same_label, FIRST), FOUND)


def _pairs(buckets: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of ``buckets`` (keys, bucket, longest) and ``blocks`` (keys, block, reach, least) with equal keys that can hold a score.

    Buckets of one key are dealt to slices, so that a hot label or the only number of components is no hot key.
    """
    slices = max(1, min(4096, buckets.count() // PAIRS))
    cut = buckets.withColumn("slice", F.pmod(F.xxhash64("bucket"), F.lit(slices)).cast("int"))
    spread = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    met = cut.join(spread, [*keys, "slice"]).where(F.col("reach") * F.col("longest") * (1 + SLACK) >= F.col("least"))
    return met.groupBy("dims", "bucket", "block").agg(F.max("longest").alias("longest"))


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, *, positives: int = 5, negatives: int = 3, low_percent: tuple[int, int] = (50, 100), high_percent: tuple[int, int] = (95, 100)
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows``.

    ``rows`` has ``id``, ``label``, ``vector`` (whole numbers) and ``anchor`` (boolean); other columns are left alone. A score is the inner product
    with the anchor; higher ones come first, ties by the lesser id. An anchor's positives are the first ``positives`` other
    rows of its label; for each, its negatives are the first rows of other labels whose score lies between ``low_percent`` and ``high_percent`` of the
    positive's: low[0] * positive <= low[1] * negative, high[1] * negative <= high[0] * positive.

    Rows without id, label or vector, with a NULL component, or so long that scores need more than 64 bits (2^28) take no part. Of rows
    with one id the least by label, then vector, counts. Vectors with other numbers of components than the anchor's have no
    score with it. An anchor without positives, or a positive without negatives, gives no row; so does an empty table.
    """
    spark = rows.sparkSession
    folder = work_folder(spark, "hard-negatives")
    named = rows.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "vector", F.coalesce("anchor", F.lit(False)).alias("anchor"))
    table = _indexed(named, folder)
    table.groupBy("dims", "bucket", "label").agg(F.max("length").alias("longest")).write.parquet(f"{folder}/buckets")
    buckets = spark.read.parquet(f"{folder}/buckets")
    anchors = spark.read.parquet(f"{folder}/rows").where("anchor").select("id", "label", "vector", "dims", "length")
    blocks = max(1, anchors.count() // BLOCK)
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def open_bands(low: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("tag"), F.lit(0).alias("tag_score"), low.alias("low"), F.lit(MOST).alias("high"))).cast(BANDS)

    def blocks_of(asked: DataFrame, keys: list[str]) -> DataFrame:
        least = F.min(F.array_min(F.transform("bands", lambda b: b["low"])))
        return asked.groupBy(*keys, "block").agg(F.max("length").alias("reach"), least.alias("least"))

    # Positives: the bucket with a label's longest rows first; the k-th score there bounds what others must reach.
    own = ["dims", "label"]
    longest = Window.partitionBy(*own).orderBy(F.col("longest").desc(), "bucket")
    order = buckets.withColumn("nth", F.row_number().over(longest))
    asked = anchors.withColumn("bands", open_bands(F.lit(LEAST)))
    firsts = order.where("nth = 1").drop("nth")
    _search(table, asked, _pairs(firsts, blocks_of(asked, own), own), positives, True).write.parquet(f"{folder}/first")
    first = spark.read.parquet(f"{folder}/first")
    full = first.groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= positives)
    bounds = full.select(F.col("anchor_id").alias("id"), "kth")
    asked = anchors.join(bounds, "id", "left").withColumn("bands", open_bands(F.coalesce("kth", F.lit(LEAST)))).drop("kth")
    others = order.where("nth > 1").drop("nth")
    more = _search(table, asked, _pairs(others, blocks_of(asked, own), own), positives, True)
    # A bucket that ends one label and begins the next can be met in both turns.
    _top(first.union(more).distinct(), ["anchor_id"], positives).write.parquet(f"{folder}/positives")
    found = spark.read.parquet(f"{folder}/positives")

    # Negatives: a band of scores for each positive. Below 0 the band is empty, as it is where no whole number lies in it.
    low = f"(score * {low_percent[0]} + {low_percent[1] - 1}) div {low_percent[1]}"
    high = f"score * {high_percent[0]} div {high_percent[1]}"
    band = F.struct(F.col("id").alias("tag"), F.col("score").alias("tag_score"), F.expr(low).alias("low"), F.expr(high).alias("high"))
    bands = found.where(f"score >= 0 AND {low} <= {high}").groupBy("anchor_id").agg(F.collect_list(band).cast(BANDS).alias("bands"))
    asked = anchors.join(bands.withColumnRenamed("anchor_id", "id"), "id")
    whole = buckets.groupBy("dims", "bucket").agg(F.max("longest").alias("longest"))
    near = _search(table, asked, _pairs(whole, blocks_of(asked, ["dims"]), ["dims"]), negatives, False)
    best = _top(near, ["anchor_id", "tag"], negatives)
    return best.select(
        "anchor_id", F.col("tag").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("tag_score").alias("positive_score"), F.col("score").alias("negative_score")
    )
