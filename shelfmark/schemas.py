"""Table schemas.  Readers are always given one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


# Python-side, because StructType.fromDDL needs a running session.
_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
    "properties": T.MapType(T.StringType(), T.StringType()),
}


def _struct(fields: str) -> T.StructType:
    """"name type, name type, ..." with the types above."""
    pairs = (field.split() for field in fields.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMA_VERSION = "1.0"
SNAPSHOT_VERSION = "1"
DEFAULT_TTL_SECONDS = 3600

PAGE = _struct(
    "url string, html string, rendered_html string, captured_at timestamp, page_kind string, "
    "domain string, query string, page_num int"
)
SNAPSHOT = _struct("url_key string, url string, html string, cached_at timestamp, ttl_seconds int, version string")
FETCH_LOG = _struct(
    "url string, attempt int, error string, error_type string, captcha_seen boolean, html string, at timestamp"
)
REQUEST = _struct(
    "request_id bigint, search_term string, product_urls strings, domain string, max_results int, "
    "max_pages int, max_reviews int, retries int, timeout int, wait int, zip string"
)
PROCESSED = _struct("url string, processed_at timestamp")
OUTCOME = _struct("url string, attempt int, stage string, reason string, hint string, message string")
SEARCH_CARD = _struct(
    "query string, domain string, page_num int, card_pos int, url string, asin string, title string, "
    "price string, rating string, review_count string, is_prime boolean"
)
REVIEW = _struct(
    "url string, asin string, round int, pos int, text string, rating string, date string, "
    "verified boolean, helpful_votes int"
)
VARIANT = _struct("asin string, label string, price string, is_selected boolean")
REVIEW_ITEM = _struct("text string, rating string, date string, verified boolean, helpful_votes int")
# The product record, field for field and in order.
PRODUCT = T.StructType(
    [
        *_struct(
            "url string, title string, price string, rating string, review_count string, images strings, "
            "bullets strings, availability string, asin string, brand string, model_number string, "
            "date_first_available string, manufacturer string, item_weight string, dimensions string, "
            "department string, best_sellers_rank string, category_path string"
        ).fields,
        T.StructField("variants", T.ArrayType(VARIANT)),
        *_struct(
            "seller_name string, fulfilled_by_amazon boolean, seller_rating string, seller_rating_count string, "
            "buybox_owner boolean, ships_from string, original_price string, discount_percentage string, "
            "deal_type string, is_on_sale boolean, savings_amount string"
        ).fields,
        T.StructField("reviews", T.ArrayType(REVIEW_ITEM)),
        *_struct(
            "schema_version string, scraped_at timestamp, from_cache boolean, extraction_quality properties"
        ).fields,
    ]
)
# Declared in the record, filled by no rule; kept so that the table has every column.
UNFILLED = [
    "model_number", "date_first_available", "manufacturer", "item_weight", "dimensions", "department",
    "best_sellers_rank", "category_path",
]
