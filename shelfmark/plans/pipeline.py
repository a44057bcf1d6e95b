"""Whole runs: seeds and captured pages in, products and outcomes out.

No page text is ever shuffled: a Bloom filter of the wanted URLs drops other pages where they are
read, the rest is parsed there, and only product rows are moved, reduced per URL and attempt
before each shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.outcomes import BEYOND_RETRIES, GATE_SERVED, INCOMPLETE, NO_PAGE, error_stage
from shelfmark.functions.urls import url_key
from shelfmark.operators.grouping import first_per
from shelfmark.operators.membership import possible
from shelfmark.operators.outcomes import choose_attempt, outcome_columns
from shelfmark.operators.products import extract_products, is_complete
from shelfmark.operators.requests import MAX_RETRIES, RETRIES, url_seeds
from shelfmark.operators.reviews import attach_reviews
from shelfmark.operators.search import walk_urls
from shelfmark.operators.snapshots import newest_only, with_status
from shelfmark.rules import SEARCH_RULES, Rule
from shelfmark.schemas import OUTCOME, PRODUCT


# What a walk says about a result.
_FOUND = ("query", "domain", "result_rank")


@dataclass(frozen=True)
class Run:
    """What a run yields: every pending seed in exactly one of the two tables.

    Both come from ``rows`` (one row a seed, ``ok`` tells which).  Taking both from a lazy run parses
    the pages twice; :func:`write_run` writes the rows once and gives the two tables from there.
    """

    products: DataFrame
    outcomes: DataFrame
    rows: DataFrame


def _tables(rows: DataFrame, extra: Sequence[str]) -> Run:
    made = [*OUTCOME.fieldNames(), "ok"]
    siblings = [name for name in rows.columns if name not in {*PRODUCT.fieldNames(), *made, *extra}]
    products = rows.where("ok").select(*extra, *PRODUCT.fieldNames(), *siblings)
    return Run(products, rows.where("NOT ok").select(*extra, *OUTCOME.fieldNames()), rows)


def write_run(run: Run, path: str) -> Run:
    """Write a run's rows, partitioned by ``ok``, and return it as read from there."""
    extra = [name for name in run.outcomes.columns if name not in OUTCOME.fieldNames()]
    run.rows.write.partitionBy("ok").parquet(path)
    return _tables(run.rows.sparkSession.read.schema(run.rows.schema).parquet(path), extra)


_ATTEMPT = ["url", "attempt", "html", "rendered_html", "captured_at", "error", "error_type", "captcha_seen", "cached", "status"]


def _as_attempts(table: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Pages, fetch logs and snapshots in one shape."""
    return table.select(
        *(
            (F.col(name) if name in table.columns else defaults.get(name, F.lit(None))).alias(name)
            for name in _ATTEMPT
        )
    ).select(
        "url",
        F.greatest(F.col("attempt").cast("int"), F.lit(0)).alias("attempt"),
        *(F.col(name).cast("string") for name in ("html", "rendered_html")),
        F.col("captured_at").cast("timestamp"),
        *(F.col(name).cast("string") for name in ("error", "error_type")),
        *(F.coalesce(F.col(name).cast("boolean"), F.lit(False)).alias(name) for name in ("captcha_seen", "cached")),
        F.coalesce(F.col("status").cast("string"), F.lit("hit")).alias("status"),
        F.xxhash64("html", "error", "error_type").alias("tie"),
    )


def attempts_for(
    seeds: DataFrame, pages: DataFrame, snapshots: DataFrame | None, *, as_of: Column, retries: int = RETRIES, located: bool = False
) -> DataFrame:
    """Every page that may answer a seed: the newest snapshot as attempt 0, then the fetches.

    A fetch without a number, or with one below 1, is the first.  Fetches beyond ``retries`` stay as one row
    number ``retries + 1`` without their page, to tell why a URL has no product.  No page is shuffled here; some
    rows of other URLs and some older snapshots are among the result.  Pages of other URLs are told by a filter of at most 16 MB, which serves some
    ten million URLs; ``located`` pages (:mod:`sources.bucketed`) lie by URL, and any number of seeds comes to them instead.
    """
    wanted = seeds.select("url").distinct()
    fetched = pages.withColumn("attempt", F.greatest(F.coalesce("attempt", F.lit(1)), F.lit(1)) if "attempt" in pages.columns else F.lit(1))
    near = F.col("attempt") <= retries
    texts = [name for name in ("html", "rendered_html") if name in fetched.columns]
    fetched = fetched.withColumns({name: F.when(near, F.col(name)) for name in texts} | {"attempt": F.least(F.col("attempt"), F.lit(retries + 1))})
    found = _as_attempts(fetched.join(wanted, "url", "left_semi") if located else possible(fetched, F.col("url"), wanted), {})
    if snapshots is None:
        return found
    keys = wanted.select(url_key(F.col("url")).alias("url_key"))
    stored = with_status(newest_only(snapshots, keys), as_of).withColumnRenamed("cached_at", "captured_at")
    cached = _as_attempts(stored.withColumn("attempt", F.lit(0)), {"cached": F.lit(True)})
    return cached.unionByName(found)


def _best(parsed: DataFrame) -> DataFrame:
    """One row for each URL and attempt: the newest snapshot if it is valid; of fetches a good one, the newest."""
    good = F.when(F.col("attempt") > 0, F.col("ok").cast("int")).otherwise(0)
    order = [good.desc(), F.col("captured_at").desc_nulls_last(), F.col("tie")]
    return first_per(parsed, ["url", "attempt"], order).where("status = 'hit'")


def run_seeds(
    seeds: DataFrame,
    pages: DataFrame,
    *,
    snapshots: DataFrame | None = None,
    as_of: Column,
    retries: int = RETRIES,
    rules: Sequence[Rule] | None = None,
    located: bool = False,
) -> DataFrame:
    """One row for every seed: product columns, outcome columns, and ``ok``.

    ``seeds`` has ``url``, ``retries`` (at most the argument) and any columns that tell seeds of one URL
    apart; equal seeds count once.
    """
    seeds = seeds.distinct()
    own = [name for name in seeds.columns if name not in ("url", "retries")]
    attempts = attempts_for(seeds, pages, snapshots, as_of=as_of, retries=retries, located=located)
    kept = ["attempt", "captured_at", "error", "error_type", "captcha_seen", "cached", "status", "tie"]
    parsed = extract_products(attempts, keep=kept, rules=rules, gate=True)
    best = _best(parsed.withColumn("ok", is_complete(parsed) & F.col("error").isNull()))
    asked = seeds.select(*(F.col(name).alias(f"_{name}") for name in seeds.columns))
    found = asked.join(best, F.col("_url") == F.col("url"), "left")
    # A fetch beyond a seed's own retries counts only as a sign that there was one.
    beyond = F.col("attempt") > F.col("_retries")
    rank = F.when(F.col("attempt").isNull(), 2).when(beyond, 1).otherwise(0)
    found = found.withColumns({"_why": rank, "ok": F.coalesce(F.col("ok"), F.lit(False)) & (rank == 0)})
    found = found.withColumn("attempt", F.when(rank == 0, F.col("attempt")))
    chosen = choose_attempt(found, F.col("ok"), keys=tuple(f"_{name}" for name in seeds.columns), first=[F.col("_why")])

    failed = F.col("error").isNotNull() | F.col("error_type").isNotNull()
    gate = F.coalesce(F.col("is_gate"), F.lit(False))
    stage = (
        F.when(F.col("_why") > 0, "navigation")
        .when(failed, error_stage(F.col("error"), F.col("error_type"), F.col("captcha_seen")))
        .when(gate, "captcha")
        .otherwise("parse")
    )
    reason = (
        F.when(F.col("_why") == 2, NO_PAGE)
        .when(F.col("_why") == 1, BEYOND_RETRIES)
        .when(failed, F.col("error"))
        .when(gate, GATE_SERVED)
        .otherwise(INCOMPLETE)
    )
    scraped = F.when(F.col("cached"), F.col("captured_at")).otherwise(as_of.cast("timestamp"))
    rows = chosen.withColumns({"url": F.col("_url"), "from_cache": F.col("cached"), "scraped_at": F.when(F.col("ok"), scraped)})
    rows = outcome_columns(rows, F.when(~F.col("ok"), stage), F.when(~F.col("ok"), reason))
    rows = rows.withColumn("message", F.when(~F.col("ok"), F.col("message")))
    siblings = [name for name in parsed.columns if name not in {*PRODUCT.fieldNames(), *kept, "is_gate", "ok"}]
    told = [name for name in OUTCOME.fieldNames() if name != "url"]
    return rows.select(*(F.col(f"_{name}").alias(name) for name in own), *PRODUCT.fieldNames(), *siblings, *told, "ok")


def _pending(seeds: DataFrame, processed: DataFrame | None) -> DataFrame:
    """Seeds whose URL was not processed, or that ask for a fresh run."""
    if processed is not None:
        done = processed.select(F.col("url").alias("_done")).distinct()
        seeds = seeds.join(done, seeds["url"] == done["_done"], "left").where(F.col("_done").isNull() | F.col("fresh_run"))
    return seeds.drop("_done", "fresh_run")


def build_products(
    seeds: DataFrame,
    pages: DataFrame,
    *,
    snapshots: DataFrame | None = None,
    reviews: DataFrame | None = None,
    processed: DataFrame | None = None,
    as_of: Column,
    retries: int = RETRIES,
    max_reviews: int = 0,
    fresh_run: bool = False,
    rules: Sequence[Rule] | None = None,
    located: bool = False,
) -> Run:
    """URL to product for every pending seed.

    A valid snapshot is used if its product is complete, else the first complete
    fetch within ``retries``.  Every other URL gets one outcome: its last error, a challenge
    page, an incomplete page, or that there is no captured page.  ``located``: see :func:`attempts_for`.
    """
    return _answered(seeds.select("url"), pages, [], snapshots, reviews, processed, as_of, retries, max_reviews, fresh_run, rules, located)


def _answered(seeds, pages, extra, snapshots, reviews, processed, as_of, retries, max_reviews, fresh_run, rules, located) -> Run:
    """A run over ``seeds`` (url and the columns ``extra``, which come along with products and outcomes)."""
    todo = seeds.select("url", *extra, F.lit(retries).alias("retries"), F.lit(fresh_run).alias("fresh_run"))
    rows = run_seeds(_pending(todo, processed), pages, snapshots=snapshots, as_of=as_of, retries=retries, rules=rules, located=located)
    if reviews is not None:
        rows = attach_reviews(rows, reviews, max_reviews)
    return _tables(rows, extra)


def run_requests(
    requests: DataFrame,
    pages: DataFrame,
    *,
    search_pages: DataFrame | None = None,
    snapshots: DataFrame | None = None,
    reviews: DataFrame | None = None,
    processed: DataFrame | None = None,
    as_of: Column,
    rules: Sequence[Rule] | None = None,
    search_rules: Sequence[Rule] = SEARCH_RULES,
) -> Run:
    """Normalised requests to products and outcomes, each with its ``request_id``.

    A URL-mode request stands for its listed URLs, a search-mode request for what a walk over its
    query's result pages finds (``query``, ``domain`` and ``result_rank`` tell where).  Every request keeps its own
    ``retries``, ``max_results``, ``max_pages``, ``max_reviews`` and ``fresh_run``; two requests for one query or
    URL get their own rows.  A rejected request gets one outcome without a URL.
    """
    own = ["request_id", "retries", "max_reviews", "fresh_run"]
    none = {"query": F.lit(None).cast("string"), "domain": F.lit(None).cast("string"), "result_rank": F.lit(None).cast("int")}
    seeds = url_seeds(requests).select(*own, "url").withColumns(none)
    if search_pages is not None:
        asked = requests.where("mode = 'search' AND reject IS NULL").withColumnRenamed("search_term", "query")
        # A captured result page names its host, with or without "www."; both belong to one walk.
        shown = search_pages.withColumns({"host": F.col("domain"), "domain": F.regexp_replace("domain", r"^www\.", "")})
        # Only pages of queries that are asked for are parsed.
        shown = possible(shown, F.struct("query", "domain"), asked.select(F.struct("query", "domain")).distinct())
        walked = walk_urls(shown, limits=asked.select("request_id", "query", "domain", "max_results", "max_pages"), rules=search_rules)
        found = walked.where("request_id IS NOT NULL").select("request_id", "query", "domain", "result_rank", "url")
        seeds = seeds.unionByName(found.join(asked.select(*own), "request_id").select(*own, "url", *none))
    todo = _pending(seeds, processed)
    rows = run_seeds(todo, pages, snapshots=snapshots, as_of=as_of, retries=MAX_RETRIES, rules=rules)
    if reviews is not None:
        most = requests.agg(F.max("max_reviews")).first()[0] or 0
        rows = attach_reviews(rows, reviews, most).withColumn("reviews", F.slice("reviews", 1, F.col("max_reviews")))
    extra = ["request_id", *none]
    rejected = requests.where("reject IS NOT NULL").select("request_id", F.lit("scrape").alias("stage"), F.col("reject").alias("reason"), F.lit(False).alias("ok"))
    rows = rows.drop("max_reviews").unionByName(rejected, allowMissingColumns=True)
    return _tables(rows, extra)


def products_for_requests(requests: DataFrame, pages: DataFrame, **options) -> Run:
    """The URL-mode requests alone."""
    return run_requests(requests.where("mode = 'urls' AND reject IS NULL"), pages, **options)


def products_for_searches(
    search_pages: DataFrame,
    pages: DataFrame,
    *,
    max_results: int = 5,
    max_pages: int = 3,
    limits: DataFrame | None = None,
    search_rules: Sequence[Rule] = SEARCH_RULES,
    snapshots: DataFrame | None = None,
    reviews: DataFrame | None = None,
    processed: DataFrame | None = None,
    as_of: Column,
    retries: int = RETRIES,
    max_reviews: int = 0,
    fresh_run: bool = False,
    rules: Sequence[Rule] | None = None,
    located: bool = False,
) -> Run:
    """Search mode: walk each query's result pages, then the product of every result.

    Every result is in exactly one of the tables, with ``query``, ``domain`` and ``result_rank`` (and ``request_id``, where the limits have one); a result that fails is
    an outcome and never stops the others.  A URL that several queries found is parsed once and comes out for each.
    """
    walked = walk_urls(search_pages, max_results=max_results, max_pages=max_pages, limits=limits, rules=search_rules)
    found = [name for name in ("request_id", *_FOUND) if name in walked.columns]
    return _answered(walked.select(*found, "url"), pages, found, snapshots, reviews, processed, as_of, retries, max_reviews, fresh_run, rules, located)
