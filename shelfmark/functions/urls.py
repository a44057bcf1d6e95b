"""URL, marketplace domain and identifier functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import bind, extract, filled, lookup, strip

DEFAULT_DOMAIN = "amazon.com"

# Marketplace domain -> time zone and locale (the default has none).
DOMAIN_LOCALE = {
    "amazon.ae": ("Asia/Dubai", "en-AE"),
    "amazon.co.uk": ("Europe/London", "en-GB"),
    "amazon.de": ("Europe/Berlin", "de-DE"),
    "amazon.fr": ("Europe/Paris", "fr-FR"),
    "amazon.it": ("Europe/Rome", "it-IT"),
    "amazon.es": ("Europe/Madrid", "es-ES"),
    "amazon.ca": ("America/Toronto", "en-CA"),
    "amazon.co.jp": ("Asia/Tokyo", "ja-JP"),
    "amazon.in": ("Asia/Kolkata", "en-IN"),
    "amazon.com.au": ("Australia/Sydney", "en-AU"),
    "amazon.com.br": ("America/Sao_Paulo", "pt-BR"),
    "amazon.com.mx": ("America/Mexico_City", "es-MX"),
    "amazon.nl": ("Europe/Amsterdam", "nl-NL"),
    "amazon.se": ("Europe/Stockholm", "sv-SE"),
    "amazon.pl": ("Europe/Warsaw", "pl-PL"),
    "amazon.sg": ("Asia/Singapore", "en-SG"),
    "amazon.eg": ("Africa/Cairo", "en-EG"),
    "amazon.sa": ("Asia/Riyadh", "en-SA"),
    "amazon.tr": ("Europe/Istanbul", "tr-TR"),
}
DOMAINS = [DEFAULT_DOMAIN, *DOMAIN_LOCALE]
# Query parameters that only track.
TRACKING_PARAMS = [
    "sbo", "tag", "ref", "ref_", "pf_rd_r", "pf_rd_p", "pf_rd_m",
    "pf_rd_s", "pf_rd_t", "pf_rd_i", "linkCode", "linkId", "language",
    "th", "psc", "smid", "coliid", "colid", "ie",
    "sr", "s", "qid", "crid", "sprefix", "dchild", "rh", "pf", "keywords",
]

# RFC 3986 split: scheme and authority / path / query / fragment.
_PARTS = r"(?s)^((?:[^:/?#]+:)?(?://[^/?#]*)?)([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_AUTHORITY = r"^(?:[^:/?#]+:)?//([^/?#]*)"
_PATH_REF = r"/ref=[^/]*/?\z"


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def host(url: Column) -> Column:
    """Lower-case host without user info and port; '' where the URL has none.

    A pattern rather than ``parse_url``, which raises on the malformed URLs a crawl holds.
    """
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"^\[([^\]]*)\].*$", "$1"), r"^([^:]*):\d*$", "$1"))


def marketplace_domain(url: Column, default: str = DEFAULT_DOMAIN) -> Column:
    """Host without ``www.`` and ``smile.`` where it names the marketplace, else the default."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r"^smile\.", "")
    return F.when(F.contains(name, F.lit("amazon")), name).otherwise(F.lit(default))


def known_domain(url: Column) -> Column:
    """The listed domain the host equals or is below, else NULL."""
    names = "|".join(d.replace(".", r"\.") for d in DOMAINS)
    return extract(host(url), rf"(?:^|\.)({names})\z", 1)


def first_known_domain(urls: Column) -> Column:
    """Domain of the first recognized URL of an array."""
    return F.get(F.filter(F.transform(urls, known_domain), lambda d: d.isNotNull()), F.lit(0))


def domain_timezone(domain: Column) -> Column:
    return lookup({name: zone for name, (zone, _) in DOMAIN_LOCALE.items()}, domain)


def domain_locale(domain: Column) -> Column:
    return lookup({name: locale for name, (_, locale) in DOMAIN_LOCALE.items()}, domain)


def clean_url(url: Column, params: Iterable[str] = TRACKING_PARAMS, host_pattern: str = "amazon") -> Column:
    """Drop tracking parameters and a trailing path ref; order and bytes of the rest stay.

    Only URLs whose authority matches ``host_pattern`` change.
    """
    head, path, query, fragment = (F.regexp_extract(url, _PARTS, part) for part in range(1, 5))
    tracking = F.array(*(F.lit(p) for p in sorted(set(params))))

    def name(pair: Column) -> Column:
        raw = F.substring_index(pair, "=", 1)
        return F.coalesce(F.try_url_decode(raw), raw)

    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda pair: (pair != "") & ~F.array_contains(tracking, name(pair))), "&"
    )
    rebuilt = F.concat(
        head,
        F.regexp_replace(path, _PATH_REF, ""),
        F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )
    return F.when(authority(url).rlike(host_pattern), rebuilt).otherwise(url)


def url_key(url: Column) -> Column:
    """Snapshot key: SHA-256 of the URL in hex."""
    return F.sha2(url, 256)


def page_asin(url: Column) -> Column:
    """Item id in a product page URL; the path words are case-sensitive."""
    return F.upper(extract(url, r"/(?:dp|gp/product|product)/([A-Za-z0-9]{10})", 1))


def url_asin(url: Column) -> Column:
    """Item id in any product URL, the mobile form included; all case-insensitive."""
    return F.upper(extract(url, r"(?i)(?:/dp/|/gp/product/|/gp/aw/d/)([A-Z0-9]{10})", 1))


def output_key(url: Column) -> Column:
    """Output file name of a product: its upper-case id in the URL, else ``product``."""
    return F.coalesce(
        extract(url, r"/dp/([A-Z0-9]{10})", 1), extract(url, r"/gp/product/([A-Z0-9]{10})", 1), F.lit("product")
    )


def asin_is_valid(asin: Column) -> Column:
    return F.coalesce(asin.rlike(r"^[a-zA-Z0-9]{10}$"), F.lit(False))


def quote_plus(text: Column) -> Column:
    """Form encoding that leaves ``~`` and encodes ``*`` (Java's encoder does the reverse)."""
    encoded = F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~"))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


def search_url(domain: Column, query: Column, page_num: Column | None = None) -> Column:
    base = F.concat(F.lit("https://"), domain, F.lit("/s?k="), quote_plus(query))
    if page_num is None:
        return base
    suffix = F.concat(F.lit("&page="), page_num.cast("string"))
    return F.concat(base, F.coalesce(suffix, F.lit("")))


def absolute_card_url(href: Column, domain: Column) -> Column:
    """Result link without query and trailing ref, on the shop's domain if it was relative."""
    path = F.regexp_replace(F.regexp_replace(href, r"\?.*$", ""), r"/ref=[^/]*/?$", "")
    site = F.concat(F.lit("https://"), domain)
    return bind(
        path,
        lambda path: F.when(F.startswith(path, F.lit("/")), F.concat(site, path))
        .when(F.startswith(path, F.lit("http")), path)
        .otherwise(F.concat(site, F.lit("/"), path)),
    )


def mask_credentials(text: Column) -> Column:
    """Hide ``user:password`` between ``//`` and ``@``, wherever it occurs."""
    return F.regexp_replace(text, "//[^@]+@", "//***:***@")


def split_urls(text: Column) -> Column:
    """One URL per line; blanks dropped. NULL stays NULL."""
    lines = F.transform(F.split(text, r"\R|[\x1c-\x1e]"), lambda url: filled(strip(url)))
    return F.filter(lines, lambda url: url.isNotNull())
