"""Shards by fractional rank, against a plain version."""

import hashlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import sharding as S


def brute(rows, shards, seed=S.SEED):
    """{row: (shard, slot)} of rows (id, source, text)."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    line = []
    for source, members in by_source.items():
        members.sort(key=lambda r: (hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2] is not None, r[2] or ""))
        name = "" if source is None else f"={source}"
        line += [(Fraction(2 * i + 1, 2 * len(members)), len(members), name.encode(), row) for i, row in enumerate(members)]
    line.sort(key=lambda e: e[:3])
    out, slots = [], Counter()
    for place, (*_, row) in enumerate(line):
        shard = place * shards // len(line)
        out.append((*row, shard, slots[shard]))
        slots[shard] += 1
    return out


def found(spark, rows, shards, **options):
    table = spark.createDataFrame([(i, s, t) for i, s, t in rows], "doc_id bigint, source string, text string")
    return [tuple(r) for r in S.placed(table, shards, **options).select("doc_id", "source", "text", "shard", "slot").collect()]


ROWS = [(i, f"s{min(i % 11, 4)}" if i % 7 else None, f"t{i}") for i in range(500)]
ODD = [(None, "a", "x"), (None, "a", "y"), (None, None, None), (3, "a", ""), (3, "a", ""), (3, "b", "long " * 200_000), (4, "", "z"), (5, "b", None)]


@pytest.mark.parametrize("rows", [ROWS, ODD, [(1, "a", "x")], [(i, f"own{i}", "") for i in range(50)]])
@pytest.mark.parametrize("shards", [1, 7, 24])
def test_places(spark, rows, shards, monkeypatch):
    monkeypatch.setattr(S, "ZONE_ROWS", 16)
    assert sorted(found(spark, rows, shards), key=str) == sorted(brute(rows, shards), key=str)


def test_every_shard_matches_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(S, "ZONE_ROWS", 64)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 5}", "") for i in range(6000)]
    shards = 24
    counts = Counter((source, shard) for _, source, _, shard, _ in found(spark, rows, shards))
    for source, n in Counter(s for _, s, _ in rows).items():
        assert all(abs(counts[source, k] - n / shards) < 2 for k in range(shards))
    per_shard = Counter(shard for _, shard in counts.elements())
    assert max(per_shard.values()) - min(per_shard.values()) <= 1


def test_rank_arithmetic_needs_no_64_bits(spark):
    n, other = 30_000_000_000, 20_000_000_001
    rank = 29_999_999_998
    row = spark.range(1).select(F.lit(rank).alias("sharding_r"), F.lit(n).alias("sharding_n"), F.lit(1).cast("bigint").alias("sharding_nth"))
    before = row.select(S._rows_before({n: 2, other: 3}).alias("p")).first()["p"]
    below = ((2 * rank + 1) * other + n - 1) // (2 * n)
    tie = ((2 * rank + 1) * other - n) % (2 * n) == 0
    assert before == 2 * rank + 3 * below + 3 * tie + 1


def test_another_seed_gives_another_order(spark):
    one, two = ({r[:3]: r[3:] for r in found(spark, ROWS, 4, seed=s)} for s in (1, 2))
    assert one != two and one.keys() == two.keys()


def test_files_hold_the_rows_in_slot_order(spark, tmp_path):
    table = spark.createDataFrame(ROWS, "doc_id bigint, source string, text string").withColumn("slot", F.lit("mine"))
    rows = S.write_shards(table, f"{tmp_path}/out", 5)
    assert rows.columns == ["doc_id", "source", "text", "slot", "shard", "sharding_slot"]
    assert {(r.doc_id, r.source, r.text, r.shard, r.sharding_slot) for r in rows.collect()} == set(brute(ROWS, 5))
    assert {r.slot for r in rows.select("slot").distinct().collect()} == {"mine"}
    for file in (tmp_path / "out").rglob("*.parquet"):
        slots = [r.sharding_slot for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)


def test_no_rows(spark):
    table = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert S.placed(table, 24).collect() == []


def test_text_moves_once(spark):
    """Counting reads ids and sources alone; one exchange carries the text."""
    table = spark.createDataFrame(ROWS, "doc_id bigint, source string, text string")
    plan = S.placed(table, 24)._jdf.queryExecution().executedPlan().toString()
    assert "PythonEvalType" not in plan and "ArrowEvalPython" not in plan and "MapInArrow" not in plan
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "sharding_zone" in line]
    assert len([line for line in moved if "REPARTITION_BY_COL" in line]) == 1
