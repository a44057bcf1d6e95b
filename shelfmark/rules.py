"""Selector rules: which element of a page feeds which field.

A rule is data.  The default tables below are plain rows; a caller can add rows,
replace them, or load them from a table with :func:`rules_from_table`.

``scope``    empty for the page, else the name of another rule field: the rule is
             then evaluated inside each element that field found.
``rank``     priority inside a field; the lowest rank that finds something wins.
``mode``     ``first``  the first element of each selector, in rank order
             ``all``    every element any of the field's selectors finds, in page order
             ``first_or_page``  only for scopes: the first ranked match, else the page, in which
                        only ``nodes`` rules look
             ``nodes``  text nodes matching ``pattern``; ``selector`` then names the
                        tags of the following element to report
``form``     ``tight`` / ``spaced`` / ``raw`` text, or ``none``
``clean``    what is cut off the text before it counts: ``shop_tail`` (": Shop name" at its end),
             ``byline`` ("Visit the ... Store", "Brand: ..."), or nothing
``attrs``    attributes to report, separated by commas; for ``nodes`` which texts around the
             node: ``parent_tight``, ``parent_spaced``, ``next_tight``, ``next_spaced``
``pattern``  regular expression the text must contain, else there is no hit; one made by :func:`holds` is not
             looked for again inside an element whose text lacks it
``until``    regular expression; a hit whose text has it settles the field, and no later hit is reported.  For
             ``nodes`` it is matched against "name:text" of each text around the node

All rules of a field have one mode, which decides the field's shape; the other columns count
rule by rule.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_SCHEMA = T.StructType(
    [
        T.StructField("page_kind", T.StringType(), False),
        T.StructField("scope", T.StringType(), False),
        T.StructField("field", T.StringType(), False),
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("selector", T.StringType(), False),
        T.StructField("mode", T.StringType(), False),
        T.StructField("form", T.StringType(), False),
        T.StructField("attrs", T.StringType(), False),
        T.StructField("pattern", T.StringType(), True),
        T.StructField("clean", T.StringType(), True),
        T.StructField("until", T.StringType(), True),
    ]
)

# A rule table is configuration.  It is read on the driver, so its size is checked.
MAX_RULES = 5_000


@dataclass(frozen=True)
class Rule:
    page_kind: str
    scope: str
    field: str
    rank: int
    selector: str
    mode: str = "first"
    form: str = "tight"
    attrs: str = ""
    pattern: str | None = None
    clean: str | None = None
    until: str | None = None


# How a pattern begins that only asks what a text holds, wherever it stands.
HOLDS = r"(?is)\A(?=.*?"


def holds(*parts: str) -> str:
    """A pattern for texts that hold each of ``parts``, in any order and case.

    Parts are expressions without anchors or looks around, so that what a text lacks any piece of it lacks too.
    """
    return HOLDS + ")(?=.*?".join(f"(?:{part})" for part in parts) + ")"


def ranked(page_kind: str, field: str, selectors: list[str], scope: str = "", **options) -> list[Rule]:
    return [Rule(page_kind, scope, field, rank, css, **options) for rank, css in enumerate(selectors, 1)]


def cleaned(rules: list[Rule], clean: dict[int, str]) -> list[Rule]:
    """The rules, those of some ranks with a clean-up."""
    return [replace(rule, clean=clean.get(rule.rank)) for rule in rules]


# A character class of the currency symbols prices are shown with.
CURRENCY = "[$£€¥₹]"

# Words of a sentence that names an earlier price, and words that make a badge a deal badge.
WAS_WORDS = "was|list price"
DEAL_WORDS = "deal|lightning|discount|save|off|sale"
# ``until`` must only hold where the column expressions are sure to find a value, so it asks for plain ASCII.
_WAS_PRICE = rf"(?ias)\A(?=.*?(?:{WAS_WORDS}))(?:.*?)(?:{CURRENCY}\s*[0-9]|[0-9]\s*{CURRENCY})"
_SOLD_BY = r"[ \t]*sold[ \t]+by[ \t:]+[!-9;-~][^\n]*\Z"

# Selector lists per field, most trusted first.
PRICE = [
    "#corePrice_feature_div .a-offscreen",
    "#corePrice_desktop .a-offscreen",
    "#unifiedPrice_feature_div .a-offscreen",
    "#corePriceDisplay_desktop_feature_div .aok-offscreen",
    "#corePriceDisplay_desktop_feature_div .a-offscreen",
    "#apex-pricetopay-accessibility-label",
    "#priceblock_ourprice",
    "#priceblock_dealprice",
    "#price_inside_buybox",
]
ANY_PRICE = '.a-price:not(.a-text-price):not(div[id^="CardInstance"] *)'
ORIGINAL_PRICE = [
    ".a-text-price .a-offscreen",
    "#listPrice .a-offscreen",
    "#priceblock_ourprice .a-text-price .a-offscreen",
    ".a-size-base.a-color-secondary .a-offscreen",
    '[data-testid="odal-original-price"] .a-offscreen',
    ".a-section.a-spacing.microverse .a-text-price span",
]
TITLE = ["#productTitle", "title"]
RATING = ["span[data-hook='rating-out-of-text']", ".a-icon-alt"]
REVIEW_COUNT = ["span[data-hook='total-review-count']", "#acrCustomerReviewText"]
IMAGE = [
    "#imgTagWrapperId img",
    "#main-image-container img",
    "#altImages img",
    ".imgTagWrapper img",
    "#landingImage",
    "#main-image",
]
IMAGE_CONTAINER = ["#imgTagWrapperId", "#main-image-container", "#altImages"]
AVAILABILITY = ["#availability span", "#deliveryBlockMessage"]
BRAND = [
    "#bylineInfo",
    "#bylineInfo_feature_div",
    "a.brand-link",
    "a[href*='/stores/brand/']",
    "#po-brand .a-span2",
]
DETAIL_ROW = [
    "#productDetails_detailBullets_sections1 tr",
    "#prodDetails tr",
    "#productDetails_techSpec_section_1 tr",
]
SELLER = [
    "#bylineInfo",
    "#bylineInfo_feature_div",
    "#merchant-info",
    "#merchantInfo",
    '[data-feature-name="bylineInfo"]',
    "#byline",
    "#bylineInfo_text",
    ".tabular-buybox-text:nth-child(2) span",
]
FULFILMENT = ["#tabular-buybox[data-csa-c-content-id='btfbb']", "#tabular-buybox"]
SELLER_RATING = [
    "#sellerProfileTriggerId",
    "#merchant-vars:not(:empty)",
    '[data-hook="avg-star-rating"]',
    "#avgRating",
    ".reviewCountTextLinkedHistogram",
]
SHIPS_FROM = [
    "#shipsFrom",
    "#shipsFromDetail",
    ".tabular-buybox-text",
    "#deliveryBlockMessage",
    "#ubb-ufss-slot",
    "#mir-layout-DELIVERY_BLOCK-slot-PRIMARY_DELIVERY_MESSAGE_LARGE",
]
BUYBOX = [
    "#buybox",
    "#BuyBox",
    "#buybox-see-all-buying-choices",
    "#addToCart_feature_div",
    "#corePrice_feature_div",
    "#corePriceDisplay_desktop_feature_div",
    "#centerCol",
]
DEAL = [
    "#dealBadge_feature_div",
    "#dealBadge",
    ".dealBadge",
    '[data-hawkeye-key="mkcp.dealbadge"]',
    ".dealLabel",
    ".a-badge.aok-align-bottom",
    ".a-row.a-spacing-mini .a-color-price",
    "#saleBadge",
    ".a-row.a-size-base.a-color-price",
]
COUPON = [".couponBadge", '[data-hook="promo-price"]', ".a-section.couponClippableBlock", ".promoBadge"]
CARD = ['[data-component-type="s-search-result"]']
CARD_LINK = ["h2 a.a-link-normal", "h2 a.a-text-normal", "a.a-link-normal.s-link-style"]
CARD_REVIEW_COUNT = [
    "span.a-size-base.s-underline-text",
    "a.a-size-base[href*='customer-reviews']",
    "span.a-size-base[aria-label*='ratings']",
]

PRODUCT_RULES: list[Rule] = [
    *cleaned(ranked("product", "title", TITLE), {2: "shop_tail"}),
    *ranked("product", "price", PRICE, pattern=CURRENCY),
    *ranked("product", "generic_price", [ANY_PRICE], mode="all", form="none"),
    *ranked("product", "shown", [".a-offscreen"], scope="generic_price"),
    *ranked("product", "rating", RATING),
    *ranked("product", "review_count", REVIEW_COUNT),
    *ranked("product", "image", IMAGE, mode="all", form="none", attrs="data-old-hires,src"),
    *ranked("product", "image_set", IMAGE_CONTAINER, mode="all", form="none", attrs="data-a-dynamic-image"),
    *ranked("product", "bullet", ["#feature-bullets li"], mode="all", form="spaced"),
    *ranked("product", "availability", AVAILABILITY),
    *ranked("product", "meta_asin", ["meta[name='asin']"], mode="all", form="none", attrs="content"),
    *ranked("product", "input_asin", ["input[name='ASIN']"], form="none", attrs="value"),
    *ranked("product", "detail_row", DETAIL_ROW, mode="all", form="none"),
    *ranked("product", "head", ["th, .a-span3"], scope="detail_row"),
    *ranked("product", "value", ["td, .a-span9"], scope="detail_row"),
    *cleaned(ranked("product", "brand", BRAND), {1: "byline"}),
    *ranked("product", "overview_row", ["#productOverview_feature_div tr, .po-brand"], mode="all", form="none"),
    *ranked("product", "head", ["td:first-child, .a-span3"], scope="overview_row"),
    *ranked("product", "value", ["td:nth-child(2), .a-span9"], scope="overview_row"),
]
DEAL_RULES: list[Rule] = [
    *ranked("product", "original_price", ORIGINAL_PRICE, pattern=CURRENCY),
    *ranked("product", "was_price", [".a-text-price"], mode="all", pattern=holds(WAS_WORDS, CURRENCY), until=_WAS_PRICE),
    *ranked("product", "deal", DEAL),
    *ranked(
        "product",
        "badge",
        ['[data-hook="deal-badge"], .a-badge-span'],
        mode="all",
        pattern=holds(DEAL_WORDS),
        until=f"(?ia){DEAL_WORDS}",
    ),
    *ranked("product", "coupon", COUPON, form="none"),
]
SELLER_RULES: list[Rule] = [
    *ranked("product", "seller", SELLER),
    *ranked(
        "product", "sold_by", ["span, a"], mode="nodes", attrs="next_tight", pattern="(?i)sold by:", until="(?s)next_tight:.."
    ),
    *ranked("product", "fulfilment", FULFILMENT),
    *ranked("product", "seller_rating", SELLER_RATING),
    *ranked("product", "feedback", ["#feedbackSummaryTable, .feedbackDetailStars"], form="none"),
    *ranked("product", "stars", [".avgRating, .stars"], scope="feedback"),
    *ranked("product", "ships_from", SHIPS_FROM),
    *ranked("product", "buybox", BUYBOX, mode="first_or_page", form="spaced"),
    *ranked(
        "product",
        "sold_by_inline",
        ["a, span"],
        scope="buybox",
        mode="all",
        form="spaced",
        pattern=r"(?i)^\s*sold\s+by\b",
        until=rf"(?ia)\A{_SOLD_BY}",
    ),
    *ranked(
        "product",
        "sold_by_label",
        ["a, span"],
        scope="buybox",
        mode="nodes",
        attrs="parent_spaced,next_spaced",
        pattern=r"(?i)^\s*sold\s+by\b",
        until=rf"(?ia)next_spaced:(?s:.)|parent_spaced:{_SOLD_BY}",
    ),
    *ranked("product", "fulfilled_note", [""], scope="buybox", mode="nodes", pattern="(?i)sold by amazon|ships from amazon|fulfilled by amazon"),
    *ranked(
        "product",
        "ships_note",
        [""],
        scope="buybox",
        mode="nodes",
        attrs="parent_tight",
        pattern="(?i)ships from:",
        until=r"(?ia)parent_tight:[^\n]*?ships from:\s*[!-~]{3}",
    ),
]
GATE_RULES: list[Rule] = [
    *ranked("product", "gate_form", ["#captcha-form"], form="none"),
    *ranked("product", "gate_input", ["input[name='captcha']"], form="none"),
    *ranked("product", "page_title", ["title"]),
]
# Elements that only a product page has.
CONTENT_RULES: list[Rule] = ranked("product", "content", ["#productTitle, #dp, #centerCol"], form="none")
RENDERED_RULES: list[Rule] = ranked("rendered", "rendered_price", PRICE, pattern=CURRENCY)
SEARCH_RULES: list[Rule] = [
    *ranked("search", "card", CARD, mode="all", form="none"),
    *ranked("search", "link", CARD_LINK, scope="card", attrs="href,title"),
    *ranked("search", "whole", [".a-price .a-price-whole"], scope="card"),
    *ranked("search", "fraction", [".a-price .a-price-fraction"], scope="card"),
    *ranked("search", "symbol", [".a-price-symbol"], scope="card"),
    *ranked("search", "price_block", [".a-price"], scope="card"),
    *ranked("search", "offscreen", [".a-price .a-offscreen"], scope="card"),
    *ranked("search", "stars", ["i.a-icon-star, i.a-icon-star-small, span.a-icon-alt"], scope="card"),
    *ranked("search", "count", CARD_REVIEW_COUNT, scope="card"),
    *ranked("search", "prime", ["i.a-icon-prime, i.a-icon-prime-small"], scope="card", form="none"),
]
REVIEW_RULES: list[Rule] = [
    *ranked("review", "review", ['[data-hook="review"]'], mode="all", form="none"),
    *ranked("review", "body", ['[data-hook="review-body"] span', '[data-hook="review-body"]'], scope="review"),
    *ranked("review", "stars", ['[data-hook="review-star-rating"]'], scope="review"),
    *ranked("review", "date", ['[data-hook="review-date"]'], scope="review"),
    *ranked("review", "badge", ['[data-hook="avp-badge"]'], scope="review", form="raw"),
    *ranked("review", "votes", ['[data-hook="helpful-vote-statement"]'], scope="review"),
]

DEFAULT_RULES = [*PRODUCT_RULES, *DEAL_RULES, *SELLER_RULES, *GATE_RULES, *RENDERED_RULES, *SEARCH_RULES, *REVIEW_RULES]


def rules_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The rules as a table, to edit and store."""
    rows = [tuple(vars(rule).values()) for rule in (DEFAULT_RULES if rules is None else rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_from_table(table: DataFrame, page_kind: str | None = None) -> list[Rule]:
    """Read a rule table; refuses one that is too large to be configuration."""
    if page_kind is not None:
        table = table.where(F.col("page_kind") == page_kind)
    have = [F.col(n) if n in table.columns else F.lit(None).cast("string").alias(n) for n in RULE_SCHEMA.fieldNames()]
    rows = table.select(*have).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a rule table may hold at most {MAX_RULES} rows")
    return sorted((Rule(**row.asDict()) for row in rows), key=lambda r: (r.page_kind, r.scope, r.field, r.rank))


def with_rules(rules: list[Rule], *extra: Rule) -> list[Rule]:
    """``extra`` rows added behind the existing ranks of their fields."""
    out = list(rules)
    for rule in extra:
        top = max((r.rank for r in out if (r.scope, r.field) == (rule.scope, rule.field)), default=0)
        out.append(replace(rule, rank=top + 1))
    return out
