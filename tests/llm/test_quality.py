"""Quality rules against plain Python."""

import base64
import random
import re
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from shelfmark.llm import quality as Q


def prose(words, seed=1):
    random.seed(seed)
    stems = ["ta", "lor", "min", "ke", "vas", "ou", "rin", "the", "st", "em", "pla", "no"]
    vocabulary = ["".join(random.choices(stems, k=random.choice([1, 2, 3]))) for _ in range(4000)]
    return " ".join(random.choices(vocabulary, k=words))


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    often = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = [False] * len(words)
    for i in range(len(words) - 2):
        if often[tuple(words[i : i + 3])] > 1:
            inside[i : i + 3] = [True] * 3
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, sum(inside)


TEXTS = [None, "", " \n\n ", "a", "a b c a b c", "x\nx\n x\n\t\nx", "# * $%&|<> ö€𝄞", "a b c a b c", prose(400), prose(60) + "\n" + prose(60), "la la " * 4000, "w" * 500_000]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_counts(text):
    (found,) = Q.measure([(text or "").encode()])
    assert found[:5] == brute(text)


def judged(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string")
    return {r.doc_id: r for r in Q.judged(docs).collect()}


def test_base_rules_and_columns(spark):
    found = judged(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        words, _, _, _, repeat = brute(text)
        assert found[i].quality_base_failed == (words < 50 or 100 * repeat > 50 * words)
        assert not (found[i].quality_base_failed and found[i].quality_kept)
    assert found[0].n_words == "x"
    assert found[8].quality_kept and found[9].quality_base_failed  # the same sixty words twice


@pytest.mark.parametrize("words", [50, 80, 200, 900, 4000, 20000])
def test_prose_of_any_length_stays(spark, words):
    assert judged(spark, [prose(words, s) for s in range(5)])[3].quality_kept


def test_noise_and_repetition_go(spark):
    random.seed(4)
    noise = " ".join(base64.b85encode(random.randbytes(20)).decode() for _ in range(800))
    rows = ["\n".join(f"Entry {i} of the list is the same as any other entry of it, number {i % 9}." for i in range(900)), noise]
    found = judged(spark, rows)
    assert not found[0].quality_kept and not found[1].quality_kept


def test_ratio_is_that_of_zstandard():
    text = prose(3000).encode()
    ratio, chunks, _ = Q.ratios(text, zstandard.ZstdCompressor(level=Q.LEVEL))
    assert ratio == len(text) / len(zstandard.ZstdCompressor(level=Q.LEVEL).compress(text))
    assert chunks == sum(2 * len(text[i : i + Q.CHUNK_BYTES]) >= Q.CHUNK_BYTES for i in range(0, len(text), Q.CHUNK_BYTES))


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame([(1, prose(300), None), (2, "short", "y"), (None, prose(200, 3), "z")], "doc_id bigint, text string, quality_text_2 string")
    stays = Q.quality_filter(docs)
    assert stays.columns == docs.columns
    assert sorted(str(r.doc_id) for r in stays.collect()) == ["1", "None"]
    assert Q.quality_filter(docs.limit(0)).collect() == []


def narrow(words, seed):
    """Like prose, of few words in any order: no window of three words need occur twice."""
    random.seed(seed)
    vocabulary = sorted(set(prose(120, 1).split()))
    return " ".join(random.choices(vocabulary, k=words))


def test_random_words_go_without_labels(spark):
    random.seed(6)
    texts = [" ".join(base64.b64encode(random.randbytes(k)).decode() for _ in range(n)) for k, n in ((20, 60), (20, 120), (6, 280), (20, 360), (20, 2000))]
    assert all(not r.quality_base_failed and not r.quality_kept for r in judged(spark, texts).values())


def test_limits_come_from_clean_labels(spark):
    sizes = (80, 300, 1500, 3000)
    rows = [(i, prose(sizes[i // 5 % 4], 100 + i) if i % 5 else narrow(max(300, sizes[i // 5 % 4]), 100 + i), int(i % 5 != 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, 1), (3, None)], "doc_id bigint, quality int")
    limits = Q.fit(docs, labels, usable=F.col("id") % 3 != 1)
    found = {r.doc_id: r for r in Q.judged(docs, limits=limits).collect()}
    held = [(i, q) for i, _, q in rows if i % 3 == 1]
    assert sum(found[i].quality_kept for i, q in held if q) >= 0.97 * sum(q for _, q in held)
    low = [i for i, q in held if not q and not found[i].quality_base_failed]
    assert len(low) >= 10 and sum(found[i].quality_kept for i in low) <= 0.2 * len(low)
    # A text longer than all clean ones is judged by its chunks.
    long = judged_with(spark, [prose(40_000, 3), narrow(3000, 4) + prose(6000, 4)], limits)
    assert long[0].quality_kept and not long[1].quality_kept


def judged_with(spark, texts, limits):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r for r in Q.judged(docs, limits=limits).collect()}


def test_fixed_limits_hold_without_clean_labels(spark):
    docs = spark.createDataFrame([(i, prose(200, i)) for i in range(30)], "doc_id bigint, text string")
    for label in ("0", "NULL"):
        limits = Q.fit(docs, docs.selectExpr("doc_id", f"CAST({label} AS INT) AS quality"))
        assert limits == Q.Limits()


def test_limits_come_from_all_clean_texts(spark):
    """Of 40,000 labelled texts one is much more repetitive than the rest; the limits reach to it."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.hex(F.xxhash64("doc_id", i))), " ")
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), words.alias("text"))
    odd = " ".join(f"{n:016X}" for n in range(60))
    for place in (7, 19_999, 31_234):
        changed = docs.withColumn("text", F.when(F.col("doc_id") == place, odd).otherwise(F.col("text")))
        limits = Q.fit(changed, docs.select("doc_id", F.lit(1).alias("quality")))
        ratio = Q.measure([odd.encode()])[0][5]
        assert max(high for start, _, high in limits.bands if start <= len(odd)) >= ratio * (1 + Q.MARGIN) * 0.999
        kept = Q.judged(changed.filter(F.col("doc_id") == place), limits=limits).first()
        assert kept.quality_kept


def test_memory_of_a_batch_of_long_texts_is_bounded():
    """A batch is measured a few texts at a time, and a text's lines one at a time."""
    import tracemalloc

    import pyarrow as pa

    texts = [(prose(3000, seed) + "\n") * 10 for seed in range(3)] * 40 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "quality_text"])
    lines = b"ab\n" * 1_000_000
    tracemalloc.start()
    try:
        (out,) = Q._measured(iter([batch]), Q.CHUNK_LIMITS)
        assert tracemalloc.get_traced_memory()[1] < 2 * batch.nbytes
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        assert Q.duplicate_lines(lines) == 999_999
        assert tracemalloc.get_traced_memory()[1] - before < 2 * len(lines)
    finally:
        tracemalloc.stop()
    assert out.column("doc_id").to_pylist() == list(range(len(texts)))
    rows = list(zip(*(out.column(f"quality_{name}").to_pylist() for name, _ in Q.FIELDS), strict=True))
    assert rows[:3] * 40 == rows[:120] == [tuple(row) for row in Q.measure([t.encode() for t in texts[:120]])]
    assert rows[120:] == [(0, 0, 0, 0, 0, 1.0, 0, 0)] * 2
