"""The physical plans that the scale of the data asks for."""

import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import prices
from shelfmark.functions.text import strip
from shelfmark.operators import products, search, sellers
from shelfmark.operators.hits import extract_hits, hits_schema
from shelfmark.operators.requests import normalize_requests
from shelfmark.operators.reviews import top_reviews
from shelfmark.plans import pipeline
from shelfmark.rules import PRODUCT_RULES, SEARCH_RULES, SELLER_RULES
from shelfmark.schemas import PAGE, REVIEW
from shelfmark.sources.pages import as_snapshots


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "pages")
    card = "<div data-component-type='s-search-result'><h2><a class='a-link-normal' href='https://x/dp/B000000001'>t</a></h2></div>"
    rows = [
        ("https://x/dp/B000000001", "<b id='priceblock_ourprice'>$1</b>", None, None, "product", None, None, None),
        ("https://x/s", card, None, None, "search", "d", "q", 1),
    ]
    spark.createDataFrame(rows, PAGE).write.parquet(path)
    return spark.read.schema(PAGE).parquet(path)


def test_extraction_has_no_shuffle_and_reads_only_what_it_needs(pages):
    text = plan(products.extract_products(pages.where("page_kind = 'product'")))
    assert "Exchange" not in text and text.count("MapInArrow") == 1
    scan = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert sorted(part.split(":")[0] for part in scan.split(",")) == ["html", "page_kind", "rendered_html", "url"]
    assert "EqualTo(page_kind,product)" in text
    text = plan(search.extract_search(pages))
    assert "Exchange" not in text and text.count("MapInArrow") == 1
    text = plan(sellers.sellers(extract_hits(pages, SELLER_RULES)))
    assert "Exchange" not in text and "rendered_html" not in text


def test_groups_are_limited_before_the_shuffle(spark):
    rows = spark.createDataFrame([], REVIEW)
    text = plan(top_reviews(rows.repartition(4), 10))
    # One shuffle per key; on the way into each only the first rows of a group are kept.
    assert text.count("hashpartitioning") == 2
    assert len(re.findall(r"WindowGroupLimit.*Partial", text)) == 2


def test_search_pages_are_parsed_once_for_the_whole_run(spark, pages):
    stored = pages.where("page_kind = 'search'")
    run = pipeline.products_for_searches(stored, pages.where("page_kind = 'product'"), as_of=F.current_timestamp())
    found = run.products
    assert [row.price for row in found.collect()] == ["$1"]
    final = plan(found).split("== Initial Plan ==")[0]
    # The walk is used twice, to pick pages and to rank products; the second use reads the first's shuffle.
    assert "ReusedExchange" in final
    assert final.count("MapInArrow") == 2


def _exchanges(frame):
    """(columns, lines below) of every exchange of a formatted plan."""
    text = frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = re.findall(r"\(\d+\) (Exchange|BroadcastExchange)[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", text)
    assert found
    return [columns for _, columns in found]


def test_page_text_is_in_no_shuffle(spark, pages):
    """With sides too large to broadcast: nothing below or above the parse moves a page."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = as_snapshots(pages.withColumn("captured_at", F.current_timestamp()), 3600)
        run = pipeline.build_products(pages.select("url"), pages, snapshots=stored, processed=pages.select("url"), as_of=F.current_timestamp())
        for frame in (run.products, run.outcomes):
            assert not [c for c in _exchanges(frame) if "html" in c]
            text = plan(frame)
            # Captures of one URL are reduced on every partition before they are shuffled.
            assert re.search(r"WindowGroupLimit.*Partial", text)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hit_columns_follow_the_rules():
    schema = hits_schema([*PRODUCT_RULES, *SEARCH_RULES])
    assert "title" in schema.fieldNames() and "shown" not in schema.fieldNames()
    assert "link" in schema["card"].dataType.elementType.fieldNames()


def test_cards_are_worked_out_once(pages):
    """A plain explode would have the whole array of cards computed twice more, to filter on its size."""
    for found in (search.extract_search(pages), search.result_urls(pages)):
        assert plan(found).count("/dp/|/gp/product/|/product/") == 1


def test_a_walk_parses_only_pages_in_its_reach(spark, pages):
    text = plan(search.walk_urls(pages, max_pages=3))
    assert "LessThanOrEqual(page_num,3)" in text and "GreaterThanOrEqual(page_num,1)" in text
    walked = search.walk_search(pages)
    assert search.walk_urls(pages).collect() == walked.select("query", "domain", "page_num", "card_pos", "url", "result_rank").collect() != []
    asked = spark.createDataFrame([(1, "other", 5)], "request_id int, search_term string, max_pages int").withColumn("domain", F.lit("amazon.com"))
    run = pipeline.run_requests(normalize_requests(asked), pages.where("page_kind = 'product'"), search_pages=pages.where("page_kind = 'search'"), as_of=F.current_timestamp())
    # No query of the page is asked for, so the filter of queries stands below the parse.
    text = plan(run.rows)
    assert text.rindex("getbit") > text.rindex("MapInArrow") and re.search(r"page_num#\d+ <= 5", text)


def test_a_price_or_rating_is_looked_for_once(spark):
    """Inside lambdas Spark shares no common parts, so each pattern stands once in the expression."""
    texts = spark.createDataFrame([("4,55 von 5", "1.234,50 €")], "rating string, price string")
    found = texts.select(prices.normalize_rating(F.col("rating")).alias("rating"), prices.amount(F.col("price")).cast("string").alias("price"))
    text = plan(found)
    assert text.count("von|sur") == 1 and text.count(r"[^\d.,]") == 1
    assert [tuple(row) for row in found.collect()] == [("4.5 out of 5", "1234.50")]


def test_white_space_is_trimmed_without_a_pattern(spark):
    """The same characters as the pattern that it stands for."""
    ends = spark.range(1, 0x3100).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    rows = ends.select(F.concat("c", F.lit("a "), "c", F.lit("b"), "c", F.lit(" \n"), "c").alias("t"))
    assert "regexp" not in plan(rows.select(strip(F.col("t"))))
    assert rows.where(strip(F.col("t")) != F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).count() == 0
