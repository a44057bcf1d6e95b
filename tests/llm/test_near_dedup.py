"""Near duplicates against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import near_dedup as N
from shelfmark.llm._unions import components
from shelfmark.llm._words import shingle_sets
from shelfmark.session import work_folder


def brute(rows, words, percent):
    """{id: (set size, component)} of (id, text)."""
    sets = {}
    for i, text in rows:
        tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets[i] = {tuple(tokens[k : k + words]) for k in range(len(tokens) - words + 1)} or ({tuple(tokens)} if tokens else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(words, share):
    return [w if random.random() > share else f"new{random.randrange(10**6)}" for w in words]


def cluster(size, seed=5):
    """Chains of edits: similarities between 0.4 and 0.95, so that stars alone do not settle it."""
    random.seed(seed)
    base = [random.choice(["red", "blue", "green", "sun", "moon", "tree", "stone", "sea", "road"]) + str(random.randrange(40)) for _ in range(120)]
    texts = [base]
    while len(texts) < size:
        texts.append(edited(random.choice(texts), random.choice([0.01, 0.03, 0.06, 0.1])))
    random.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_components_match_all_pairs(spark):
    texts = cluster(250) + cluster(60, 6)
    texts += [texts[0], texts[0].upper(), texts[1].replace(" ", "\t\n"), "", None, " \n ", "one", "ONE", "one two", "Ünique", "ünique", "a b c d", "a b c d a b c d"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, kept string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_components(docs, 2, 80).collect()}
    assert found == brute(rows, 2, 80)
    assert len({c for _, c in found.values()}) > 20


def test_kept_marks_one_of_each_component(spark):
    docs = spark.createDataFrame(list(enumerate(cluster(40))), "doc_id bigint, text string")
    found = N.near_components(docs, 5, 80).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    stays = {r.doc_id for r in N.near_dedup(docs).collect()}
    assert stays == {r.component_id for r in found}


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 1), (1, long, 1), (2, long + " end", 2), (None, long, 3), (3, None, 4), (4, None, 5), (None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in N.near_components(docs).collect()), key=str)
    assert found == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True), (None, None, True)], key=str)
    stays = sorted((r.component_id for r in N.near_dedup(docs).collect()))
    assert stays == [1, 3, 4, 5, 6]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert N.near_components(docs).collect() == []
    assert N.near_dedup(docs).collect() == []


def test_unlike_texts_stay_apart(spark):
    random.seed(9)
    texts = [" ".join(f"w{random.randrange(10**6)}" for _ in range(30)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert all(r.kept for r in N.near_components(docs, 2).collect())


def test_bands_meet_with_the_chance_of_the_similarity():
    random.seed(2)
    hits = []
    for size in (5, 20, 200):
        for _ in range(200):
            base = [f"w{random.randrange(10**9)}" for _ in range(size + 1)]
            cut = base[: size - size // 5 + 1]  # 0.8 of the shingles
            a, b = N.band_numbers(list(shingle_sets([" ".join(base).encode(), " ".join(cut).encode()], 2)))
            hits.append((a == b).any())
    assert all(hits)


def test_no_bin_stays_empty():
    (few,) = shingle_sets([b"a b c"], 2)
    assert np.count_nonzero(N.band_numbers([few])) == N.BANDS


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    random.shuffle(path)
    links = spark.createDataFrame(path + star, "a bigint, b bigint").repartition(16)
    found = {r.a: r.b for r in components(links, work_folder(spark, "test")).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}}


def test_blocks_hold_every_open_pair(spark, monkeypatch):
    """A bucket larger than a block: members outside the main component meet all."""
    monkeypatch.setattr(N, "BLOCK", 4)
    rows = [(1, n, 10, 0 if n < 20 else n) for n in range(30)]
    entries = spark.createDataFrame(rows, "bucket bigint, node bigint, size bigint, part bigint")
    blocks = {}
    for r in N._blocks(entries).collect():
        blocks.setdefault((r.i, r.j), {True: set(), False: set()})[r.is_left].add(r.node)
    pairs = {(a, b) for block in blocks.values() for a in block[True] for b in block[False]}
    assert pairs == {(a, b) for a in range(20, 30) for b in range(30)}


def test_same_result_with_other_partitions(spark):
    docs = spark.createDataFrame(list(enumerate(cluster(80))), "doc_id bigint, text string")
    one = sorted(map(tuple, N.near_components(docs.repartition(1)).collect()))
    assert one == sorted(map(tuple, N.near_components(docs.repartition(13)).withColumn("kept", F.col("kept")).collect()))
