"""Ranked lexical search, against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import lexical as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(i, Counter(plain_terms(text))) for i, text in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, words in asked.items():
        scored = []
        for (identity, counts), n in zip(held, sizes, strict=True):
            score = 0
            for t in words:
                if counts[t]:
                    m = 100 - 90 + 90 * n * n_docs // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, identity is None, identity or 0, identity))
        out += [(item, rank, e[3], -e[0]) for rank, e in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in L.ranked_search(docs, items, **options).collect()), key=str)


def corpus(n, seed, words=120, longest=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" if i % 9 else f"Ünï{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(longest)))) for i in range(n)]
    docs += [(n + i, docs[i % 3][1]) for i in range(n // 3)]  # large groups of copies
    items = [(i, "-".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(20)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_all_scores(spark, seed, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 64)
    monkeypatch.setattr(L, "LEAF", 4)
    monkeypatch.setattr(L, "SLICE", 7)
    monkeypatch.setattr(L, "CELLS", 500)
    docs, items = corpus(300, seed)
    want = brute(docs, items)
    assert len(want) > 100 and found(spark, docs, items) == want


def test_several_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS", 6)
    docs, items = corpus(80, 9)
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


ODD_DOCS = [
    (None, "rare one"), (None, "rare one"), (4, "rare one"), (4, "rare one"), (2, "rare one two"), (1, None), (0, ""), (9, "... !!"), (3, "RARE\x00ONE Éa"),
    (8, "long " * 300_000 + "rare"), (7, "éa ÉA"), (6, "\x7frare\x7f"), (5, "x"),
]
ODD_ITEMS = [(1, "rare, Rare one"), (2, None), (3, ""), (4, "nothing of this"), (5, "éa"), (6, "long"), (None, "two"), (7, "x"), (7, "two"), (7, "x")]


def test_odd_rows(spark):
    want = brute(ODD_DOCS, ODD_ITEMS)
    assert {r[0] for r in want} == {1, 4, 5, 6, 7, None} - {4} and found(spark, ODD_DOCS, ODD_ITEMS) == want


def test_empty_tables(spark):
    assert found(spark, [], ODD_ITEMS) == []
    assert found(spark, ODD_DOCS, []) == []
    assert found(spark, [(1, None), (2, "")], ODD_ITEMS) == []


def test_other_columns_and_names(spark):
    docs = spark.createDataFrame([("b", "x y", 1), ("a", "x y", 2), ("c", "z", 3)], "key string, body string, score int")
    items = spark.createDataFrame([("q", "x", 7)], "item string, wanted string, rank int")
    rows = L.ranked_search(docs, items, id_column="key", text_column="body", item_column="item", item_text="wanted")
    assert rows.columns == ["item", "rank", "key", "score"]
    assert [(r.item, r.rank, r.key) for r in rows.orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]


def test_terms_are_those_of_the_pattern():
    rng = random.Random(4)
    signs = [chr(c) for c in range(256)] + list("éÉ漢𝒳 İ")
    for _ in range(500):
        text = "".join(rng.choices(signs, k=40))
        assert [t.decode() for t in L.terms(text)] == plain_terms(text)


def test_bounds_hold_and_paths_are_shared():
    rng = np.random.default_rng(6)
    vectors = [np.unique(rng.zipf(1.3, size=rng.integers(1, 30)) % 50) for _ in range(400)]
    vectors += [vectors[0]] * 100
    starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    ranks, tfs = np.concatenate(vectors), rng.integers(1, 6, size=starts[-1])
    m = rng.integers(10, 300, size=len(vectors))
    tree = L._Tree(list(range(len(vectors))), m, starts, ranks, tfs)
    columns = np.arange(51)
    weights = rng.integers(0, 9000, size=(50, 8))
    bounds = tree.bounds(columns, weights.astype(float))
    scores = np.array([[int((weights[tree.ranks[a:b], i] * tree.parts[a:b]).sum()) for i in range(8)] for a, b in zip(tree.starts[:-1], tree.starts[1:], strict=True)])
    leaves = 0
    for node, (low, high) in enumerate(zip(tree.low, tree.high, strict=True)):
        assert (scores[low:high].max(axis=0) <= bounds[node]).all()
        if tree.children[node]:
            assert [tree.low[c] for c in tree.children[node]] + [high] == [low] + [tree.high[c] for c in tree.children[node]]
        else:
            leaves += high - low
            assert high - low <= L.LEAF
    assert leaves == len(vectors)
