"""Error stages, their texts, and the rendered message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import lookup
from shelfmark.functions.urls import mask_credentials

# Stage -> default reason and hint.
STAGES = {
    "scrape": ("Scraping failed", None),
    "navigation": ("Failed to navigate to the requested page", None),
    "parse": ("Failed to parse content from the page HTML", None),
    "timeout": (
        "Page load exceeded the time limit; the browser waited too long for the DOM to reach a stable state",
        None,
    ),
    "captcha": (
        "CAPTCHA challenge presented and could not be bypassed; the page refused to load for an automated client",
        "Wait longer between requests, rotate the user agent, or use a residential proxy so the request is not "
        "flagged as bot traffic",
    ),
    "blocked": (
        "Amazon blocked the request (HTTP 503/509 or bot-detection); no product data could be retrieved",
        "Reduce request frequency, space out retries with backoff, or rotate the IP/proxy; the account or session "
        "may also be rate-limited",
    ),
}
# Texts of the two rejections found in the page itself.
INCOMPLETE = "Failed to extract price or ASIN from page"
GATE_SERVED = "CAPTCHA page served in place of product content"
# Our own: seeds that no captured page answers.
NO_PAGE = "No captured page"
BEYOND_RETRIES = "No captured page within the allowed attempts"
# Texts of a blocked request, and titles of challenge pages.
_GATE_TITLE = "(?i)robot check|captcha"
_BLOCKED = r"(?i)\b(?:503|509|403)\b|blocked|rate\s*limit|robot|bot\s*check"


def is_gate(form_hits: Column, input_hits: Column, title_hits: Column) -> Column:
    """A challenge page, by form, input or title."""
    title = F.coalesce(F.get(title_hits, F.lit(0))["text"], F.lit(""))
    return (F.size(form_hits) > 0) | (F.size(input_hits) > 0) | title.rlike(_GATE_TITLE)


def error_stage(error: Column, error_type: Column, captcha_seen: Column) -> Column:
    """Timeout, then captcha, then blocked by its text, else navigation."""
    kind = F.lower(F.coalesce(error_type, F.lit("")))
    return (
        F.when(F.contains(kind, F.lit("timeout")), "timeout")
        .when(F.coalesce(captcha_seen, F.lit(False)) | F.contains(kind, F.lit("captcha")), "captcha")
        .when(mask_credentials(error).rlike(_BLOCKED), "blocked")
        .otherwise("navigation")
    )


def stage_reason(stage: Column, given: Column) -> Column:
    return F.coalesce(mask_credentials(given), lookup({name: reason for name, (reason, _) in STAGES.items()}, stage))


def stage_hint(stage: Column) -> Column:
    return lookup({name: hint for name, (_, hint) in STAGES.items() if hint}, stage)


def message(stage: Column, reason: Column, url: Column, hint: Column) -> Column:
    head = F.concat(F.lit("["), stage, F.lit("] "), reason, F.lit(": "), url)
    return F.concat(head, F.coalesce(F.concat(F.lit("\nHINT: "), hint), F.lit("")))
