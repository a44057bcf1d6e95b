"""Exact duplicates."""

import hashlib
import re

from shelfmark.llm import exact_dedup as E

ROWS = [
    (5, "a b"), (3, "a  b"), (9, "a\n\tb"), (4, " a b"), (None, "a b"), (7, None), (6, ""), (8, " "), (None, "alone"), (None, "pair"),
    (None, "pair"), (2, "x"), (2, "x"), (1, "a b"), (0, "long " * 300_000), (11, "long\x0b" * 300_000),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, kept int")


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for i, text in rows:
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        keep = min((x for x in groups[plain] if x is not None), default=None)
        out.append((i, keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups(spark):
    found = E.exact_groups(table(spark))
    assert found.columns == ["doc_id", "text", "kept", "keep_id", "group_size", "exact_kept", "text_sha256"]
    rows = [(r.doc_id, r.keep_id, r.group_size, r.exact_kept, r.text_sha256) for r in found.collect()]
    assert sorted(rows, key=str) == brute(ROWS)


def test_one_row_of_each_text_stays(spark):
    stays = E.exact_dedup(table(spark))
    assert stays.columns == ["doc_id", "text", "kept"]
    assert sorted((r.doc_id for r in stays.collect()), key=str) == sorted([3, 4, 6, 8, 2, 1, 0, None, None], key=str)


def test_many_rows_fill_the_filter(spark, monkeypatch):
    monkeypatch.setattr(E, "MAX_BITS", 1 << 6)
    monkeypatch.setattr(E, "MIN_BITS", 1 << 6)
    rows = [(i, f"text {i % 150}") for i in range(400)]
    found = [(r.doc_id, r.keep_id, r.group_size, r.exact_kept, r.text_sha256) for r in E.exact_groups(table(spark, rows)).collect()]
    assert sorted(found, key=str) == brute(rows)


def test_lone_rows_do_not_shuffle(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id bigint, text string")
    bits = E.filter_bits(3000)
    values = docs.select("doc_id", E.normalised(docs["text"]).alias("t"))
    pages = E.repeated_positions(values, "t", bits)
    flagged = E.maybe_repeated(values, "t", pages, bits, "maybe")
    assert flagged.filter("maybe").count() < 300
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_no_python_on_the_main_path(spark):
    plan = E.exact_groups(table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert E.exact_groups(table(spark, [])).collect() == [] and E.exact_dedup(table(spark, [])).collect() == []
