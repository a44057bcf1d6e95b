"""Jobs over several rows: walks, review rounds, snapshots, attempts, requests, pipelines."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.urls import url_key
from shelfmark.operators import outcomes, requests, reviews, search, snapshots
from shelfmark.operators.links import pending
from shelfmark.plans import pipeline
from shelfmark.sources import pages as sources
from shelfmark.sources import sinks

def now():
    return F.to_timestamp(F.lit("2024-01-02 00:00:00"))


def result_page(*ids):
    return "".join(
        f"<div data-component-type='s-search-result'><h2><a class='a-link-normal' href='/dp/B{i:09d}'>t</a></h2></div>" for i in ids
    )


def walk(spark, pages, **options):
    rows = [(q, "d", n, html, at) for q, n, html, at in pages]
    table = spark.createDataFrame(rows, "query string, domain string, page_num int, html string, captured_at timestamp")
    found = search.walk_search(table, **options).orderBy("query", "result_rank").collect()
    return [(row.query, int(row.asin[1:])) for row in found]


T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def test_walk_stops(spark):
    pages = [
        ("a", 1, result_page(1, 2), T0), ("a", 2, result_page(2, 3), T0), ("a", 3, result_page(4), T0), ("a", 4, result_page(5), T0),
        ("gap", 1, result_page(1), T0), ("gap", 3, result_page(2), T0),
        ("empty", 1, result_page(1), T0), ("empty", 2, "<p>none", T0), ("empty", 3, result_page(2), T0),
        ("late", 2, result_page(1), T0),
        # A page with repeats only is not empty: the walk goes on.
        ("repeat", 1, result_page(1), T0), ("repeat", 2, result_page(1), T0), ("repeat", 3, result_page(2), T0),
        ("null", 1, None, T0), ("null", 2, result_page(1), T0),
    ]
    assert walk(spark, pages, max_results=10, max_pages=3) == [
        ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("empty", 1), ("gap", 1), ("repeat", 1), ("repeat", 2)]
    assert [n for q, n in walk(spark, pages, max_results=3, max_pages=3) if q == "a"] == [1, 2, 3]
    assert [n for q, n in walk(spark, pages, max_results=10, max_pages=1) if q == "a"] == [1, 2]


def test_walk_reads_the_newest_capture_of_a_page(spark):
    pages = [("a", 1, result_page(1), T0), ("a", 1, result_page(9), T1), ("a", 2, result_page(3), T1), ("a", 2, "", T0)]
    assert walk(spark, pages) == [("a", 9), ("a", 3)]


def test_walk_of_a_hot_query(spark):
    """A query captured thousands of times gives the same few results."""
    from shelfmark.operators.search import walk_search

    hot = spark.range(5_000).select(
        F.lit("hot").alias("query"), F.lit("d").alias("domain"), (F.col("id") % 2 + 1).cast("int").alias("page_num"),
        F.lit(result_page(1, 2)).alias("html"), F.timestamp_seconds("id").alias("captured_at"),
    )
    assert walk_search(hot, max_results=5).count() == 2


def brute_reviews(rows, limit):
    """The reading loop, round by round."""
    by_round = {}
    for rnd, pos, text, date in rows:
        by_round.setdefault(rnd, []).append((pos, text, date))
    seen, out, idle = set(), [], 0
    for rnd in range(1, max(by_round, default=0) + 1):
        before = len(out)
        for _, text, date in sorted(by_round.get(rnd, []), key=lambda r: r[0]):
            if len(out) < limit and (text, date or "") not in seen:
                seen.add((text, date or ""))
                out.append(text)
        idle = idle + 1 if len(out) == before else 0
        if idle >= 3 or len(out) >= limit:
            break
    return out


def test_reviews_match_the_reading_loop(spark):
    import random

    rng = random.Random(7)
    table, want = [], {}
    for product in range(40):
        limit = 6
        rows = []
        for rnd in sorted(rng.sample(range(1, 14), rng.randint(1, 8))):
            for pos in range(rng.randint(1, 3)):
                rows.append((rnd, pos, rng.choice(["a", "b", "c", "d", "e", "f", "g", None]), rng.choice([None, "", "d1"])))
        want[f"u{product}"] = brute_reviews(rows, limit)
        table += [(f"u{product}", *row) for row in rows]
    frame = spark.createDataFrame(table, "url string, round int, pos int, text string, date string")
    got = {url: [] for url in want}
    for row in reviews.top_reviews(frame, 6).orderBy("url", "review_rank").collect():
        got[row.url].append(row.text)
    assert got == want


def test_reviews_attach(spark):
    products = spark.createDataFrame([("u1",), ("u2",)], "url string").withColumn("reviews", F.array().cast("array<struct<text:string,rating:string,date:string,verified:boolean,helpful_votes:int>>"))
    rows = [("u1", "A", 1, i, f"t{i}", "5", None, True, 1) for i in range(3)]
    schema = "url string, asin string, round int, pos int, text string, rating string, date string, verified boolean, helpful_votes int"
    out = reviews.attach_reviews(products, spark.createDataFrame(rows, schema), 2).orderBy("url").collect()
    assert [[r.text for r in row.reviews] for row in out] == [["t0", "t1"], []]
    assert reviews.attach_reviews(products, spark.createDataFrame(rows, schema), 0) is products


def test_snapshot_expiry_is_strict(spark):
    rows = [("k1", "h", datetime(2024, 1, 1, 23, 0), 3600, "1"), ("k2", "h", datetime(2024, 1, 1, 22, 59, 59, 999999), 3600, "1"), ("k3", "", T1, 0, "1"), ("k4", "h", T1, 9, "2"), ("k5", None, T1, 9, "1"), ("k6", "h", T1, 9, None)]
    table = spark.createDataFrame(rows, "url_key string, html string, cached_at timestamp, ttl_seconds int, version string")
    got = {r.url_key: r.status for r in snapshots.with_status(table, now()).collect()}
    assert got == {"k1": "hit", "k2": "expired", "k3": "hit", "k4": "version", "k5": "no_html", "k6": "version"}


def test_snapshot_stats_without_entries(spark):
    empty = spark.createDataFrame([], "url_key string, html string, cached_at timestamp, ttl_seconds int, version string")
    assert tuple(snapshots.stats(empty, now()).first()) == (0, 0, 0, 0, 0, 0.0)


def test_snapshot_directory(spark, tmp_path):
    from hashlib import sha256

    def key(url):
        return sha256(url.encode()).hexdigest()

    at = 1704150000.5
    good = {"url": "u", "cached_at": at, "ttl_seconds": 3600, "version": "1"}
    cases = {
        "fresh": ("<p>é</p>\n", json.dumps(good)),
        "blank": ("", json.dumps(good)),
        "no_version": ("x", json.dumps({k: v for k, v in good.items() if k != "version"})),
        "old": ("x", json.dumps({**good, "cached_at": at - 10_000})),
        "other_version": ("x", json.dumps({**good, "version": "0"})),
        "broken": ("x", "{not json"),
        "extra": ("x", json.dumps({**good, "more": 1})),
        "missing": ("x", json.dumps({"url": "u", "cached_at": at})),
        "list": ("x", "[1]"),
        "no_meta": ("x", None),
        "no_html": (None, json.dumps(good)),
    }
    for name, (html, meta) in cases.items():
        if html is not None:
            (tmp_path / f"{key(name)}.html").write_text(html)
        if meta is not None:
            (tmp_path / f"{key(name)}.meta.json").write_text(meta)
    (tmp_path / "other.html").write_text("not ours")
    rows = snapshots.with_status(sources.scan_snapshot_dir(spark, str(tmp_path)), now()).collect()
    names = {key(name): name for name in cases}
    got = {names[row.url_key]: row.status for row in rows}
    # "blank" should be a hit: Spark's file sources do not show files of zero bytes.
    assert got == {
        "fresh": "hit", "blank": "no_html", "no_version": "hit", "old": "expired", "other_version": "version", "broken": "bad_meta",
        "extra": "bad_meta", "missing": "bad_meta", "list": "bad_meta", "no_meta": "no_meta", "no_html": "no_html",
    }
    fresh = next(row for row in rows if names[row.url_key] == "fresh")
    assert fresh.html == "<p>é</p>\n" and fresh.cached_at == datetime(2024, 1, 1, 23, 0, 0, 500000)


def test_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>A</title>\n<p>")
    row = sources.read_page_files(spark, str(tmp_path)).first()
    assert row.html == "<title>A</title>\n<p>" and row.url.endswith("a.html") and row.page_kind == "product"


def test_choose_attempt(spark):
    rows = [("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False), ("b", 2, False)]
    table = spark.createDataFrame(rows, "url string, attempt int, good boolean")
    got = {r.url: (r.attempt, r.ok) for r in outcomes.choose_attempt(table, F.col("good")).collect()}
    assert got == {"a": (2, True), "b": (2, False)}


def test_messages(spark):
    log = spark.createDataFrame([("u", 1, None, "TimeoutError", False), ("u", 1, "403 for http://a:b@p", "Error", False)], "url string, attempt int, error string, error_type string, captcha_seen boolean")
    first, second = outcomes.fetch_outcomes(log).collect()
    assert first.message.startswith("[timeout] Page load exceeded the time limit") and first.hint is None
    assert second.message.startswith("[blocked] 403 for http://***:***@p: u\nHINT: Reduce request frequency")


def test_requests(spark):
    raw = spark.createDataFrame(
        [
            (1, None, None, None, None, None),
            (2, " tea ", "https://www.amazon.de/dp/B000000001", "amazon.sa", "10", True),
            (3, "  ", "https://a/dp/X\nhttps://b/dp/Y\n", "example.com", "abc", None),
            (4, None, "", "amazon.fr", "500", None),
        ],
        "request_id bigint, search_term string, product_urls string, domain string, max_results string, fresh_run boolean",
    )
    rows = requests.normalize_requests(raw).orderBy("request_id").collect()
    assert [r.mode for r in rows] == ["search", "search", "urls", "search"]
    assert [r.reject is None for r in rows] == [False, True, True, False]
    assert [r.max_results for r in rows] == [5, 10, 5, 200]
    assert [r.domain for r in rows] == ["amazon.com", "amazon.sa", "amazon.com", "amazon.fr"]
    assert rows[1].search_term == "tea" and rows[1].fresh_run and rows[2].product_urls == ["https://a/dp/X", "https://b/dp/Y"]
    assert (rows[0].max_pages, rows[0].max_reviews, rows[0].retries, rows[0].timeout, rows[0].wait, rows[0].zip) == (3, 10, 2, 15000, 0, "90035")


@pytest.mark.parametrize(("given", "want"), [(0, (1, 1, 0, 1, 3000, 0)), (-5, (1, 1, 0, 1, 3000, 0)), (10**9, (200, 20, 200, 10, 120000, 30000))])
def test_request_bounds(spark, given, want):
    raw = spark.createDataFrame([tuple([given] * 6)], "max_results bigint, max_pages bigint, max_reviews bigint, retries bigint, timeout bigint, wait bigint")
    row = requests.normalize_requests(raw).first()
    assert (row.max_results, row.max_pages, row.max_reviews, row.retries, row.timeout, row.wait) == want


def test_request_urls_as_array(spark):
    raw = spark.createDataFrame([([" https://www.amazon.de/dp/B000000001?tag=x ", None, ""],)], "product_urls array<string>")
    clean = requests.normalize_requests(raw)
    assert clean.first().product_urls == ["https://www.amazon.de/dp/B000000001?tag=x"]
    seed = requests.url_seeds(clean).first()
    assert (seed.url, seed.domain) == ("https://www.amazon.de/dp/B000000001", "amazon.de")


def product_page(price):
    return f"<b id='priceblock_ourprice'>{price}</b>"


def test_pipeline(spark):
    url = "https://x/dp/B00000000{}".format
    seeds = spark.createDataFrame([(url(i),) for i in (1, 2, 3, 4, 5, 6, 1)], "url string")
    log = spark.createDataFrame(
        [
            (url(1), 1, product_page("$1"), T0, None, None),
            (url(2), 1, "<p>no price", T0, None, None),
            (url(2), 2, product_page("$2"), T0, None, None),
            (url(3), 1, None, T0, "HTTP 503", "Error"),
            (url(3), 3, product_page("$3"), T0, None, None),
            (url(4), 1, product_page("$4"), T0, None, None),
            (url(5), 1, product_page("$5"), T0, None, None),
            (url(9), 1, product_page("$9"), T0, None, None),
        ],
        "url string, attempt int, html string, captured_at timestamp, error string, error_type string",
    )
    stored = [(url(4), product_page("$40"), datetime(2024, 1, 1, 23, 30)), (url(5), "<p>incomplete", datetime(2024, 1, 1, 23, 30)), (url(1), product_page("$10"), T0)]
    snaps = spark.createDataFrame(stored, "url string, html string, captured_at timestamp")
    run = pipeline.build_products(
        seeds, log, snapshots=sources.as_snapshots(snaps, 3600), processed=spark.createDataFrame([(url(6),)], "url string"), as_of=now()
    )
    got = {r.url: (r.price, r.from_cache, r.scraped_at) for r in run.products.collect()}
    assert got == {
        url(1): ("$1", False, datetime(2024, 1, 2)),
        url(2): ("$2", False, datetime(2024, 1, 2)),
        url(4): ("$40", True, datetime(2024, 1, 1, 23, 30)),
        url(5): ("$5", False, datetime(2024, 1, 2)),
    }
    # Attempt 3 of the third URL is beyond the retries.
    assert [(r.url, r.attempt, r.stage) for r in run.outcomes.collect()] == [(url(3), 1, "blocked")]


def test_pipeline_with_a_hot_url(spark):
    """One URL with most of all captures, in seeds, pages and snapshots."""
    hot = spark.range(4_000).select(
        F.lit("https://x/dp/B000000001").alias("url"),
        F.when(F.col("id") == 2_500, F.lit(product_page("$7"))).otherwise(F.lit("<p>")).alias("html"),
        F.timestamp_seconds("id").alias("captured_at"),
    )
    cold = hot.limit(1).select(F.lit("https://x/dp/B000000002").alias("url"), F.lit(product_page("$8")).alias("html"), "captured_at")
    pages = hot.unionByName(cold)
    run = pipeline.build_products(pages.select("url"), pages, snapshots=sources.as_snapshots(pages, 1), as_of=now())
    assert sorted(r.price for r in run.products.collect()) == ["$7", "$8"]
    assert run.outcomes.count() == 0


def test_pending(spark):
    seeds = spark.createDataFrame([("a",), ("b",)], "url string")
    done = spark.createDataFrame([("a",), ("a",), (None,)], "url string")
    assert [r.url for r in pending(seeds, done).collect()] == ["b"]
    assert pending(seeds, done, fresh_run=True).count() == 2
    assert pending(seeds, None).count() == 2


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("https://x/dp/B000000001", None, "ü"), ("https://x/y", "p", None), ("https://x/z", "q", None)], "url string, price string, title string")
    sinks.write_json(table, str(tmp_path / "json"))
    lines = [json.loads(line) for part in (tmp_path / "json").glob("*.json") for line in part.read_text().splitlines()]
    assert {"url": "https://x/dp/B000000001", "price": None, "title": "ü"} in lines and len(lines) == 3
    sinks.write_product_files(table, str(tmp_path / "files"))
    assert sorted(p.name for p in (tmp_path / "files").glob("output_key=*")) == ["output_key=B000000001", "output_key=product"]
    sinks.append_processed(table, str(tmp_path / "done"), now())
    assert sinks.read_processed(spark, str(tmp_path / "done")).count() == 3
    again = sinks.stamped(sinks.stamped(table.withColumn("scraped_at", F.lit(None).cast("timestamp")), now()), F.current_timestamp())
    assert {r.scraped_at for r in again.collect()} == {datetime(2024, 1, 2)}


def test_snapshot_overwrite_and_invalidate(spark, tmp_path):
    pages = [("a", "1", T0), ("a", "2", T1), ("b", "3", T0)]
    table = sources.as_snapshots(spark.createDataFrame(pages, "url string, html string, captured_at timestamp"), 3600)
    sinks.append_snapshots(table, str(tmp_path / "s"))
    stored = sources.read_snapshots(spark, str(tmp_path / "s"))
    assert {r.url: r.html for r in snapshots.latest(stored).collect()} == {"a": "2", "b": "3"}
    left = snapshots.invalidate(stored, spark.createDataFrame([("a",)], "url string"))
    assert [r.url for r in left.collect()] == ["b"]
    assert left.where(F.col("url_key") != url_key(F.col("url"))).count() == 0


def test_work_folder(spark, tmp_path):
    from types import SimpleNamespace

    from shelfmark.session import work_folder

    def session(shared, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: shared), sparkContext=SimpleNamespace(master=master))

    assert work_folder(session("hdfs://x/shared/", "yarn"), "s").startswith("hdfs://x/shared/s-")
    with pytest.raises(ValueError):
        work_folder(session(None, "yarn"), "s")
    assert work_folder(spark, "s") != work_folder(spark, "s")


def test_product_files_are_written_whole_or_not_read(spark, tmp_path):
    from shelfmark.sources.sinks import read_product_files, write_product_files

    schema = "url string, title string, output_key string"
    rows = [(f"https://s/dp/B{n:09d}", f"t{n}" if n % 3 else None) for n in range(40)] + [(None, "é \"q\"\n"), ("https://s/x", "a"), ("https://s/y", "b")]
    products = spark.createDataFrame(rows, "url string, title string").repartition(4)
    path = f"{tmp_path}/files"
    write_product_files(products.limit(9), path)
    write_product_files(products, path)
    found = {(r.url, r.title, r.output_key) for r in read_product_files(spark, path, schema).collect()}
    assert found == {(u, t, u[-10:] if u and "/dp/" in u else "product") for u, t in rows}
    assert (tmp_path / "files" / "output_key=B000000003").is_dir()
    written = next((tmp_path / "files" / "output_key=B000000003").glob("*.json")).read_text()
    assert written == '{"url":"https://s/dp/B000000003","title":null}\n'
    fails = products.withColumn("title", F.when(F.col("url") == "https://s/y", F.raise_error(F.lit("broken"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="broken"):
        write_product_files(fails, path)
    with pytest.raises(ValueError, match="not whole"):
        read_product_files(spark, path, schema)


def test_product_files_are_read_without_a_list_of_them(spark, tmp_path):
    """The driver knows the files of the writer's table alone; lines, empty texts and odd characters come back."""
    from shelfmark.sources.sinks import read_product_files, write_product_files

    rows = [(f"https://s/dp/{n:010d}", f"t{n}") for n in range(300)] + [("https://s/x", "a b\r\nc \U0001f600"), ("https://s/y", ""), (None, None)]
    products = spark.createDataFrame(rows, "url string, title string").repartition(3)
    path = f"file://{tmp_path}/files"
    write_product_files(products, path)
    found = read_product_files(spark, path, "output_key string, title string, url string")
    assert found.columns == ["title", "url", "output_key"]
    assert len(found.inputFiles()) <= 3 and all("/_written/" in name for name in found.inputFiles())
    want = {(u, t, u[-10:] if u and "/dp/" in u else "product") for u, t in rows}
    assert {(r.url, r.title, r.output_key) for r in found.collect()} == want and found.count() == len(rows)
    assert {(r.url, r.output_key) for r in read_product_files(spark, path, "url string").collect()} == {(u, k) for u, _, k in want}
    assert read_product_files(spark, path, "output_key string").distinct().count() == 301
    # A folder without that table is read as before.
    assert spark.read.json(path).count() == len(rows)
    import shutil

    shutil.rmtree(tmp_path / "files" / "_written")
    assert read_product_files(spark, path, "title string, output_key string").count() == len(rows)
