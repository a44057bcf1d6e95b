"""Stored snapshots that are merged into, page tables in buckets, and the directory source."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_plans import _exchanges

from shelfmark.operators.snapshots import latest, with_status
from shelfmark.plans import pipeline
from shelfmark.schemas import PAGE, SNAPSHOT
from shelfmark.sources import bucketed
from shelfmark.sources import pages as sources
from shelfmark.sources.store import SnapshotStore

T0 = datetime(2024, 1, 1)


def captures(spark, rows):
    """Rows of (number, hour, html)."""
    table = spark.createDataFrame([(f"u{n}", h, None if t is None else T0 + timedelta(hours=t)) for n, t, h in rows], "url string, html string, captured_at timestamp")
    return sources.as_snapshots(table, 3600)


def held(frame):
    return sorted((r.url, r.html, r.cached_at) for r in frame.collect())


def buckets_read(frame):
    return {int(re.search(r"bucket=(\d+)", file)[1]) for file in frame.inputFiles()}


def test_merges_keep_the_newest(spark, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/s", buckets=8)
    assert held(store.read()) == []
    turns = [
        [(n, n % 3, f"a{n}") for n in range(30)] + [(1, 9, "new"), (1, 9, "new"), (2, None, "no time")],
        [(n, 1, f"b{n}") for n in range(0, 40, 4)] + [(5, None, "no time"), (50, None, "only")],
        [(7, 5, None), (8, 5, ""), (1, 8, "older")],
        [],
    ]
    everything = []
    for turn in turns:
        store.merge(captures(spark, turn))
        everything += turn
        key = lambda r: (r.url, str(r.html), str(r.cached_at))
        assert sorted(map(key, store.read().collect())) == sorted(map(key, latest(captures(spark, everything)).collect()))
    assert SnapshotStore(spark, f"{tmp_path}/s", buckets=3).buckets == 8


def test_untouched_buckets_are_not_read_or_written(spark, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/s", buckets=16)
    store.merge(captures(spark, [(n, 0, "x") for n in range(200)]))
    before = set(store.read().inputFiles())
    one = captures(spark, [(3, 1, "y")])
    (bucket,) = store._touched(one)
    assert buckets_read(store.read(one)) == {bucket}
    store.merge(one)
    changed = before ^ set(store.read().inputFiles())
    assert {int(re.search(r"bucket=(\d+)", f)[1]) for f in changed} == {bucket}
    store.invalidate(spark.createDataFrame([("u3",), ("u3",), (None,), ("none",)], "url string"))
    assert len(held(store.read())) == 199 and "u3" not in {u for u, *_ in held(store.read())}
    store.clear()
    assert held(store.read()) == []
    store.merge(one)
    assert [h for _, h, _ in held(store.read())] == ["y"]


def test_a_merge_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, f"{tmp_path}/s", buckets=4)
    store.merge(captures(spark, [(1, 0, "x"), (2, 0, "x")]))
    was = held(store.read())

    def lost(*_):
        raise RuntimeError("lost before the manifest")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", lost)
        with pytest.raises(RuntimeError):
            store.merge(captures(spark, [(1, 5, "y")]))
    assert held(store.read()) == was
    store.merge(captures(spark, [(1, 5, "y")]))
    assert [(u, h) for u, h, _ in held(store.read())] == [("u1", "y"), ("u2", "x")]


@pytest.fixture
def no_broadcasts(spark):
    """As with more wanted keys than any broadcast takes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_seeds_come_to_located_pages(spark, tmp_path, no_broadcasts):
    rows = [(f"https://x/dp/B{n:09d}", f"<b id='priceblock_ourprice'>${n}</b>", None, T0, "product", None, None, None) for n in range(40)]
    pages = spark.createDataFrame(rows, PAGE)
    bucketed.write_bucketed(pages, "located_pages", f"{tmp_path}/pages", buckets=8)
    seeds = spark.createDataFrame([(rows[n][0],) for n in (3, 5, 3)] + [("https://x/dp/B999999999",)], "url string")
    for table in (spark.table("located_pages"), bucketed.register_bucketed(spark, "located_again", f"{tmp_path}/pages", PAGE, buckets=8)):
        run = pipeline.build_products(seeds, table, as_of=F.current_timestamp(), located=True)
        assert not [columns for columns in _exchanges(run.products) if "html" in columns]
        plan = run.products._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in run.products._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "BroadcastExchange" not in plan
        assert sorted(r.price for r in run.products.collect()) == ["$3", "$5"]
        assert [r.stage for r in run.outcomes.collect()] == ["navigation"]
    for name in ("located_pages", "located_again"):
        spark.sql(f"DROP TABLE {name}")


def test_directory_source_sees_empty_pages(spark, tmp_path):
    key = lambda n: f"{n:064x}"
    meta = f'{{"url": "u", "cached_at": {(T0 - datetime(1970, 1, 1)).total_seconds()}, "ttl_seconds": 60}}'
    for n in range(25):
        if n != 3:
            (tmp_path / f"{key(n)}.html").write_text("" if n % 5 == 0 else f"<p>é{n}")
        if n != 4:
            (tmp_path / f"{key(n)}.meta.json").write_text("" if n == 6 else meta)
    (tmp_path / "other.html").write_text("x")
    (tmp_path / f"{key(99)}.html").mkdir()
    from shelfmark.sources.directory import read_directory

    rows = read_directory(spark, f"file://{tmp_path}", files_per_partition=10)
    assert rows.rdd.getNumPartitions() == 5
    found = with_status(sources.scan_snapshot_dir(spark, str(tmp_path), empty_pages=True), F.lit(T0))
    got = {int(r.url_key, 16): (r.status, r.html) for r in found.collect()}
    assert got == {n: ("no_html" if n == 3 else "no_meta" if n == 4 else "bad_meta" if n == 6 else "hit", None if n == 3 else "" if n % 5 == 0 else f"<p>é{n}") for n in range(25)}
    empty = tmp_path / "none"
    empty.mkdir()
    assert sources.scan_snapshot_dir(spark, str(empty), empty_pages=True).collect() == []


def test_pages_of_one_url_make_one_pair_of_files(spark, tmp_path):
    """The last capture counts whole: no page beside another one's meta data."""
    from workloads import render

    rows = [(n, f"https://s/{n % 40}", f"page {n}") for n in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    files = render.snapshot_files(pages, "2024-01-31 00:00:00")
    assert files.select("name").distinct().count() == files.count()
    render.write_files(files, f"file://{tmp_path}/s")
    found = with_status(sources.scan_snapshot_dir(spark, f"file://{tmp_path}/s"), F.to_timestamp(F.lit("2024-01-31 00:00:00")))
    kinds = ["hit", "expired", "version", "bad_meta", "no_meta", "no_html"]
    assert {(r.html, r.status) for r in found.collect()} == {(None if n % 6 == 5 else f"page {n}", kinds[n % 6]) for n in range(80, 120)}


def test_a_snapshot_folder_is_listed_by_a_task(spark, tmp_path):
    """The driver plans no list of files; what is there comes out as from Spark's own reader."""
    meta = f'{{"url": "u", "cached_at": {(T0 - datetime(1970, 1, 1)).total_seconds()}, "ttl_seconds": 60}}'
    for n in range(40):
        if n % 7 != 3:
            (tmp_path / f"{n:064x}.html").write_bytes(b"" if n % 5 == 0 else b"<p>\xc3\xa9 %d \xff\xe2\x82 \xf0\x9f" % n)
        if n % 4:
            (tmp_path / f"{n:064x}.meta.json").write_text("" if n % 6 == 5 else meta)
    (tmp_path / f"{99:064x}.html").mkdir()
    (tmp_path / "other.html").write_text("x")
    found = sources.scan_snapshot_dir(spark, f"file://{tmp_path}")
    assert found.inputFiles() == []
    listed = sources.scan_snapshot_dir(spark, f"file://{tmp_path}/*")  # no folder, so Spark lists the files
    assert len(listed.inputFiles()) > 40
    got = {tuple(r) for r in found.collect()}
    assert got == {tuple(r) for r in listed.collect()} and len(got) == found.count()
    assert {int(r[0], 16) for r in got} == {n for n in range(40) if n % 7 != 3 and n % 5 or n % 4 and n % 6 != 5}
    empty = tmp_path / "none"
    empty.mkdir()
    assert sources.scan_snapshot_dir(spark, str(empty)).collect() == []
