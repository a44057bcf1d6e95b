"""Product fields from hits (titles, prices, images, brand, ...), all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import prices, urls
from shelfmark.functions.outcomes import is_gate
from shelfmark.functions.text import extract, filled, first_of, first_text, lookup, ordered_distinct, strip
from shelfmark.operators import deals, sellers
from shelfmark.operators.hits import extract_hits
from shelfmark.rules import CONTENT_RULES, DEAL_RULES, GATE_RULES, PRODUCT_RULES, RENDERED_RULES, SELLER_RULES, Rule
from shelfmark.schemas import PRODUCT, SCHEMA_VERSION, UNFILLED

DEFAULT = [*PRODUCT_RULES, *DEAL_RULES, *SELLER_RULES]
MIN_IMAGE_SIZE = 200
MIN_DYNAMIC_SIZE = 500
MIN_BULLET_CHARS = 5
# Size markers in image URLs, and all markers.
_IMAGE_SIZE = r"_(?:SX|SY|SL|SS|US|SR)(\d+)_"
_IMAGE_MARK = r"\._(AC|SX|SY|SL|SS|US|SR|FM|UX|V1|BG|PK)[^.]*?_\."


# What the clean-ups cut off (the shop's name after a page title; the words around a brand).
_SHOP_TAIL = r"(?idU)\s*:\s*Amazon\..*"
_BYLINE_LEAD = r"(?iU)^(?:Visit\s+the\s+|Brand:\s*)"
_BYLINE_TAIL = r"(?iU)\s+(?:Store|Brand|Shop)$"


def cleaned_text(hit: Column) -> Column:
    """A hit's text after the clean-up of its rule."""
    text = hit["text"]
    byline = F.regexp_replace(F.regexp_replace(text, _BYLINE_LEAD, ""), _BYLINE_TAIL, "")
    return (
        F.when(hit["clean"] == "shop_tail", F.regexp_replace(text, _SHOP_TAIL, ""))
        .when(hit["clean"] == "byline", byline)
        .otherwise(text)
    )


def title(hits: Column) -> Column:
    """First non-empty, cleaned as its rule says."""
    return strip(first_of(hits, lambda hit: filled(cleaned_text(hit))))


def static_price(price_hits: Column, generic_hits: Column) -> Column:
    """Ranked price blocks (text with a currency symbol), then any price component outside ad cards."""
    generic = first_of(generic_hits, lambda hit: first_text(hit["shown"]))
    return F.coalesce(first_text(price_hits), generic)


def rendered_price(hits: Column) -> Column:
    return first_of(hits, lambda hit: extract(strip(hit["text"]), prices.PRICE_RENDERED))


def rating(hits: Column) -> Column:
    return first_of(hits, lambda hit: prices.normalize_rating(hit["text"]))


def review_count(hits: Column) -> Column:
    return first_of(hits, lambda hit: prices.digits_only(hit["text"]))


def is_large_image(url: Column) -> Column:
    """By the size marker in the URL; without a marker the image counts as large."""
    size = extract(url, _IMAGE_SIZE, 1)
    return size.isNull() | F.coalesce(size.try_cast("decimal(38,0)") >= MIN_IMAGE_SIZE, F.lit(True))


def image_base(url: Column) -> Column:
    """URL without its size marker: equal for all sizes of one image."""
    return F.regexp_replace(url, _IMAGE_MARK, ".")


def images(image_hits: Column, set_hits: Column) -> Column:
    """Large images of the gallery tags, then of the size maps by width; one per base image."""
    tags = F.filter(
        F.flatten(
            F.transform(image_hits, lambda hit: F.array(hit["attrs"]["data-old-hires"], hit["attrs"]["src"]))
        ),
        lambda url: (url != "") & is_large_image(url),
    )

    def by_width(hit: Column) -> Column:
        sizes = F.from_json(hit["attrs"]["data-a-dynamic-image"], "map<string,array<double>>")
        entries = F.transform(
            F.map_entries(sizes),
            lambda e, at: F.struct(-F.get(e["value"], F.lit(0)), at, e["key"], F.array_max(e["value"])),
        )
        wide = F.filter(F.array_sort(entries), lambda e: e["col4"] > MIN_DYNAMIC_SIZE)
        return F.coalesce(F.transform(wide, lambda e: e["key"]), F.array().cast("array<string>"))

    items = F.concat(tags, F.flatten(F.transform(set_hits, by_width)))
    return ordered_distinct(items, image_base)


def bullets(hits: Column) -> Column:
    long_enough = F.filter(
        F.transform(hits, lambda hit: strip(hit["text"])), lambda text: F.char_length(text) >= MIN_BULLET_CHARS
    )
    return ordered_distinct(long_enough, F.lower)


def asin(url: Column, meta_hits: Column, input_hits: Column) -> Column:
    """From the URL (upper-cased), else the first valid meta tag, else the form input."""

    def valid(value: Column) -> Column:
        return F.when(urls.asin_is_valid(value), value)

    return F.coalesce(
        urls.page_asin(url),
        first_of(meta_hits, lambda hit: valid(hit["attrs"]["content"])),
        first_of(input_hits, lambda hit: valid(hit["attrs"]["value"])),
    )


def _table_value(rows: Column) -> Column:
    """Array with the value of the first row whose header has the word "brand"; may hold ''."""
    named = F.filter(
        rows,
        lambda row: F.get(row["head"], F.lit(0))["text"].rlike(r"(?iU)\bbrand\b") & (F.size(row["value"]) > 0),
    )
    return F.transform(F.slice(named, 1, 1), lambda row: F.get(row["value"], F.lit(0))["text"])


def brand(detail_rows: Column, byline_hits: Column, overview_rows: Column) -> Column:
    """Details table, then byline, then overview table."""
    return F.coalesce(
        F.get(_table_value(detail_rows), F.lit(0)),
        strip(first_of(byline_hits, lambda hit: filled(cleaned_text(hit)))),
        F.get(_table_value(overview_rows), F.lit(0)),
    )


def _sources(rules: Sequence[Rule]) -> Column:
    """Which selector gave each single-valued field: ``extraction_quality``."""

    def winner(field: str) -> Column:
        names = {r.rank: f"css: {r.selector}" for r in rules if (r.scope, r.field) == ("", field)}
        return lookup(names, first_of(F.col(field), lambda hit: F.when(hit["text"] != "", hit["rank"])))

    found = F.array(
        *(
            F.struct(F.lit(field).alias("key"), winner(field).alias("value"))
            for field in ("title", "price", "availability", "original_price", "deal", "ships_from")
            if any((r.scope, r.field) == ("", field) for r in rules)
        ),
        F.struct(
            F.lit("asin").alias("key"),
            F.when(urls.page_asin(F.col("url")).isNotNull(), F.lit("url")).alias("value"),
        ),
    )
    return F.map_from_entries(F.filter(found, lambda e: e["value"].isNotNull()))


def product_hits(
    pages: DataFrame, *, keep: Sequence[str] = (), rules: Sequence[Rule] | None = None, html: str = "html"
) -> DataFrame:
    """One hits row per product page; the rendered page is read only when the static one has no price."""
    rules = DEFAULT if rules is None else rules
    rendered = "rendered_html" if "rendered_html" in pages.columns else None
    return extract_hits(
        pages,
        rules,
        keep=["url", *keep],
        html=html,
        rendered=rendered,
        rendered_rules=RENDERED_RULES if rendered else (),
        rendered_unless=("price",),
    )


def parse_products(hits: DataFrame, *, keep: Sequence[str] = (), rules: Sequence[Rule] | None = None) -> DataFrame:
    """Hits to the full product record plus typed siblings; one row in, one row out, no shuffle."""
    rules = DEFAULT if rules is None else rules
    col = F.col
    shown = rendered_price(col("rendered_price")) if "rendered_price" in hits.columns else F.lit(None).cast("string")
    fields = hits.select(
        "url",
        *keep,
        title(col("title")).alias("title"),
        static_price(col("price"), col("generic_price")).alias("static_price"),
        shown.alias("shown_price"),
        rating(col("rating")).alias("rating"),
        review_count(col("review_count")).alias("review_count"),
        images(col("image"), col("image_set")).alias("images"),
        bullets(col("bullet")).alias("bullets"),
        first_text(col("availability")).alias("availability"),
        asin(col("url"), col("meta_asin"), col("input_asin")).alias("asin"),
        brand(col("detail_row"), col("brand"), col("overview_row")).alias("brand"),
        *deals.deal_fields(),
        *sellers.seller_fields(),
        _sources(rules).alias("extraction_quality"),
    )
    # The discount compares with the static price only: a rendered price carries no deal.
    priced = deals.with_discount(sellers.with_ownership(fields), "static_price")
    record = {
        "price": F.coalesce("static_price", "shown_price"),
        "variants": F.array().cast(PRODUCT["variants"].dataType),
        "reviews": F.array().cast(PRODUCT["reviews"].dataType),
        "schema_version": F.lit(SCHEMA_VERSION),
        "scraped_at": F.lit(None).cast("timestamp"),
        "from_cache": F.lit(False),
        **{name: F.lit(None).cast("string") for name in UNFILLED},
    }
    out = priced.select(
        *(record.get(name, F.col(name)).alias(name) for name in PRODUCT.fieldNames()), *keep
    )
    return out.withColumns(
        {
            "price_amount": prices.amount(F.col("price")),
            "rating_value": prices.rating_value(F.col("rating")),
            "review_count_n": F.col("review_count").try_cast("bigint"),
        }
    )


def extract_products(
    pages: DataFrame, *, keep: Sequence[str] = (), rules: Sequence[Rule] | None = None, html: str = "html", gate: bool = False
) -> DataFrame:
    """PAGE to PRODUCT: one Python pass over each page, then column expressions.

    ``rules`` replace the default product, deal and seller rules.  With ``gate``, a column
    ``is_gate`` tells challenge pages served in place of a product; the same pass finds them.
    """
    rules = list(DEFAULT if rules is None else rules)
    if not gate:
        return parse_products(product_hits(pages, keep=keep, rules=rules, html=html), keep=keep, rules=rules)
    hits = product_hits(pages, keep=keep, rules=[*rules, *GATE_RULES, *CONTENT_RULES], html=html)
    hits = hits.withColumn("is_gate", served_gate(hits))
    return parse_products(hits, keep=[*keep, "is_gate"], rules=rules)


def served_gate(hits: DataFrame) -> Column:
    """A challenge by its form, input or title, on a page without any product element."""
    gate = is_gate(hits["gate_form"], hits["gate_input"], hits["page_title"])
    return gate & (F.size(hits["content"]) == 0)


def is_complete(products: DataFrame) -> Column:
    """The gate: a product needs a price and an item id."""
    return (F.coalesce(products["price"], F.lit("")) != "") & (F.coalesce(products["asin"], F.lit("")) != "")


def validated(products: DataFrame) -> DataFrame:
    return products.withColumns(
        {
            "asin_valid": urls.asin_is_valid(F.col("asin")),
            "price_valid": prices.price_is_valid(F.col("price")),
            "rating_valid": prices.rating_is_valid(F.col("rating")),
        }
    )
