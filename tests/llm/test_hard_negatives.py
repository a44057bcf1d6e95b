"""Hard negatives, against all inner products."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import hard_negatives as H


def brute(rows, positives=5, negatives=3):
    """``rows``: (id, label, vector, anchor); of rows with one id the least counts."""
    once = {}
    for identity, label, vector, anchor in rows:
        if identity is None or label is None or vector is None or None in vector or sum(x * x for x in vector) > 2**56:
            continue
        once[identity] = min(once.get(identity, (label, vector, anchor)), (label, vector, anchor))
    out = []
    for a, (label, vector, anchor) in once.items():
        if not anchor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, v, strict=True)), i, l) for i, (l, v, _) in once.items() if i != a and len(v) == len(vector))
        for minus, p, _ in [s for s in scored if s[2] == label][:positives]:
            score = -minus
            fit = [(-m, i) for m, i, l in scored if l != label and 50 * score <= 100 * -m and 100 * -m <= 95 * score]
            out += [(a, p, rank, i, score, s) for rank, (s, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def found(spark, rows):
    table = spark.createDataFrame(rows, "id bigint, label int, vector array<bigint>, anchor boolean")
    return sorted(tuple(r) for r in H.hard_negatives(table).collect())


def normal(n, dims, labels, seed, spread=40, hot=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    out = []
    for i in range(n):
        label = 0 if rng.random() < hot else int(rng.integers(labels))
        vector = spread * (centres[label] * rng.choice([0, 1, 1]) + 0.8 * rng.normal(size=dims)) * rng.choice([0.2, 1, 3])
        out.append((i, label, [int(x) for x in vector], i % 9 == 0))
    return out


@pytest.mark.parametrize(("dims", "labels", "hot"), [(24, 3, 0.5), (2, 40, 0.2)])
def test_as_all_products(spark, monkeypatch, dims, labels, hot):
    """Several buckets a label, several blocks, pruning from the first rows on."""
    monkeypatch.setattr(H, "BUCKET", 32)
    monkeypatch.setattr(H, "BLOCK", 10)
    monkeypatch.setattr(H, "FIRST", 4)
    monkeypatch.setattr(H, "PAIRS", 4)
    rows = normal(240, dims, labels, seed=dims, hot=hot)
    want = brute(rows)
    assert want and found(spark, rows) == want


ODD = [
    (None, 1, [1, 2], True), (1, None, [1, 2], True), (2, 1, None, True), (3, 1, [1, None], True), (4, 1, [], True), (5, 2, [], False),
    (6, 1, [0, 0], True), (7, 1, [0, 0], False), (8, 2, [0, 0], False), (9, 2, [5, -5], False), (10, 1, [5, 5], True), (10, 1, [5, 5], True),
    (10, 1, [9, 9], False), (11, 1, [4, 5], False), (12, 3, [3, 3], False), (13, 3, [3, 3], False), (14, 3, [3, 3], False), (15, 3, [3, 3], False),
    (16, 1, [7], True), (17, 2, [7], False), (18, 1, [6], False), (19, 5, [2**40, 0], True), (20, 1, [-5, -5], True), (21, 9, [1, 1], None),
    (22, 4, [2**20, 2**20], True), (23, 4, [2**20, 2**20 - 3], False), (24, 5, [2**20, 2**19], False), (25, 1, [5], False), (26, 2, [4], False),
]


def test_odd_rows(spark):
    want = brute([(i, l, v, bool(a)) for i, l, v, a in ODD])
    assert want and found(spark, ODD) == want


def test_many_equal_rows(spark, monkeypatch):
    """A third of the rows are copies of one vector; ties go by id."""
    monkeypatch.setattr(H, "BUCKET", 64)
    rows = normal(300, 8, 3, seed=5)
    rows += [(1000 + i, 0, rows[0][2], i % 50 == 0) for i in range(150)] + [(2000 + i, 1, [x * 3 // 4 for x in rows[0][2]], False) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [1], False), (2, 1, [1], False)]) == []


def test_pruning_leaves_rows_out_and_none_that_counts():
    """Fewer rows than all are verified, and every row that reaches the score is among them."""
    rng = np.random.default_rng(3)
    vectors = (200 * rng.normal(size=(2000, 16)) * np.linspace(0.1, 1, 16) ** 3).astype(np.int64)
    table = pa.table(
        {
            "id": np.arange(2000),
            "label": np.zeros(2000, np.int64),
            "length": np.sqrt((vectors.astype(float) ** 2).sum(axis=1)),
            "vector": pa.array(list(vectors), pa.list_(pa.int64())),
        }
    )
    bucket, seen = H._Bucket(table), 0
    for i in range(0, 2000, 40):
        anchor, length = vectors[i], float(np.sqrt((vectors[i].astype(float) ** 2).sum()))
        scores = bucket.scores(slice(None), anchor, length)
        for part in (0.5, 0.8, 0.95):
            least = int(part * scores.max())
            rows = np.arange(2000)[bucket.candidates(anchor, length, least)]
            wanted = np.nonzero(scores >= least)[0]
            assert set(wanted[wanted >= H.FIRST]) <= set(rows)
            seen += len(rows)
    assert seen < 0.5 * 2000 * 150


def test_components(spark):
    rows = [([0.5, -0.001],), ([float("nan"), 1.0],), ([float("-inf")],), ([None],), (None,), ([],)]
    table = spark.createDataFrame(rows, "v array<float>").select(H.whole_components(F.col("v")).alias("w"))
    assert [r.w for r in table.collect()] == [[128, -1], None, None, None, None, []]
