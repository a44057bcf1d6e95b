"""Streams of fetches: the attempt that counts for each URL, and fetches that meet their pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.outcomes import GATE_SERVED, INCOMPLETE, NO_PAGE, error_stage
from shelfmark.operators.outcomes import outcome_columns
from shelfmark.operators.products import extract_products, is_complete
from shelfmark.rules import Rule
from shelfmark.schemas import OUTCOME, PRODUCT
from shelfmark.streaming.keyed import Gathering, gathered, has_key, milliseconds, only_better, packed, unpacked


class _Attempts(Gathering):
    """Holds the best attempt so far, and which numbers from 1 to ``retries`` were seen."""

    def __init__(self, keys: Sequence[str], idle_ms: int, retries: int | None):
        super().__init__(keys, idle_ms)
        self.retries = retries

    def empty(self) -> dict:
        return {"best": None, "seen": []}

    def add(self, held: dict, row: dict) -> None:
        number = row["attempt"]
        if self.retries is not None:
            if number is None or number > self.retries:
                return
            if number >= 1 and number not in held["seen"]:
                held["seen"].append(number)
        least = -(1 << 62) if number is None else number
        rank = [row["ok"], -least if row["ok"] else least, row["at_us"] is not None, row["at_us"] or 0, row["payload"]]
        if held["best"] is None or rank > held["best"][0]:
            held["best"] = [rank, number]

    def over(self, held: dict) -> bool:
        if self.retries is None or held["best"] is None:
            return False
        ok, number = held["best"][0][0], held["best"][1]
        needed = number - 1 if ok else self.retries
        return len([n for n in held["seen"] if n <= needed]) == needed and (ok or needed > 0)

    def result(self, key: tuple, held: dict) -> Iterator[Row]:
        if held["best"] is not None:
            (ok, *_, payload), number = held["best"]
            yield Row(url=key[0], attempt=number, ok=ok, payload=payload)


def attempt_stream(fetches: DataFrame, ok: Column, *, retries: int | None = None, time: str = "at", idle: str = "10 minutes", delay: str = "0 seconds") -> DataFrame:
    """One row for each URL of a stream of fetches (url, attempt, a time, any other columns): the first good attempt, or else the last one.

    With ``retries``, attempts beyond that number do not count, and the row comes out as soon as no attempt can change it: the
    first good one once all before it are known, the last one once all are. Else, and where numbers are missing, it comes once the
    URL had no fetch for ``idle``. One attempt told twice counts by its newest time. Adds ``ok``, as the batch rule
    (:func:`operators.outcomes.choose_attempt`) does. State per URL: one row and the numbers up to ``retries``. A
    fetch without a URL only moves the watermark.
    """
    kept = T.StructType([field for field in fetches.schema.fields if field.name not in ("url", "attempt", "ok")])
    rows = fetches.withWatermark(time, delay).withColumn("ok", F.coalesce(ok, F.lit(False)))
    # Packing takes the time column along, so the operator's copy of it has a name of its own.
    rows = rows.withColumns({"fetched_at": F.col(time), "at_us": F.unix_micros(time), "attempt": F.col("attempt").cast("int")})
    rows = packed(rows, kept.fieldNames())
    good = F.when(F.col("ok"), -F.col("attempt")).otherwise(F.col("attempt"))
    if retries is None:
        rows = rows.withColumns({"by_ok": F.col("ok").cast("int"), "by_number": good})
        rows = rows.mapInArrow(only_better(["url"], ["by_ok", "by_number", "at_us"]), rows.schema).drop("by_ok", "by_number")
    chosen = gathered(rows, _Attempts(["url"], milliseconds(idle), retries), "url string, attempt int, ok boolean, payload string", "fetched_at")
    return unpacked(chosen, kept).select(*[name for name in fetches.columns if name != "ok"], "ok")


def fetched_products(
    fetches: DataFrame, pages: DataFrame, *, wait: str = "10 minutes", delay: str = "10 minutes", rules: Sequence[Rule] | None = None
) -> DataFrame:
    """Every fetch of a log stream as one product or one outcome: product and outcome columns, ``attempt``, ``at``, ``ok``.

    ``fetches`` (url, attempt, at, error, error_type, captcha_seen) meet ``pages`` (url, attempt, captured_at, html, rendered_html) that were
    captured at most ``wait`` after the fetch began. A fetch that told an error, or whose page is a challenge, incomplete or missing, is an
    outcome; a missing page is known once both streams' watermarks have passed ``wait``. Either stream may be
    ``delay`` late. Lines and pages that repeat a URL and attempt count once. A row without a URL only moves the watermark; an absent attempt number is 1.

    Pages are parsed before they are joined, so no page text is held as state, and both sides leave it with the watermark.
    """
    number = F.coalesce(F.col("attempt").cast("int"), F.lit(1))
    asked = fetches.select(
        F.col("url").alias("_url"), number.alias("_attempt"), "at", *(F.col(n) for n in ("error", "error_type")), F.coalesce("captcha_seen", F.lit(False)).alias("captcha_seen")
    )
    asked = asked.withWatermark("at", delay).where(has_key(F.col("_url"), F.col("at"))).dropDuplicatesWithinWatermark(["_url", "_attempt"])
    shown = pages.withColumn("attempt", number).withWatermark("captured_at", delay).where(has_key(F.col("url"), F.col("captured_at")))
    parsed = extract_products(shown, keep=["attempt", "captured_at"], rules=rules, gate=True)
    parsed = parsed.dropDuplicatesWithinWatermark(["url", "attempt"])
    parsed = parsed.withColumn("whole", is_complete(parsed))
    in_time = F.col("captured_at").between(F.col("at"), F.col("at") + F.expr(f"INTERVAL {wait}"))
    met = asked.join(parsed, (F.col("_url") == F.col("url")) & (F.col("_attempt") == F.col("attempt")) & in_time, "leftOuter")

    failed = F.col("error").isNotNull() | F.col("error_type").isNotNull()
    missing = F.col("url").isNull()
    ok = ~failed & ~missing & F.coalesce("whole", F.lit(False))
    gate = F.coalesce("is_gate", F.lit(False))
    stage = (
        F.when(failed, error_stage(F.col("error"), F.col("error_type"), F.col("captcha_seen")))
        .when(missing, "navigation").when(gate, "captcha").otherwise("parse")
    )
    reason = F.when(failed, F.col("error")).when(missing, NO_PAGE).when(gate, GATE_SERVED).otherwise(INCOMPLETE)
    rows = met.withColumns({"ok": ok, "_stage": F.when(~ok, stage), "_reason": F.when(~ok, reason)})
    rows = rows.withColumns({"url": F.col("_url"), "attempt": F.col("_attempt")})
    rows = outcome_columns(rows, F.col("_stage"), F.col("_reason"))
    rows = rows.withColumns({"message": F.when(~F.col("ok"), F.col("message")), "scraped_at": F.when(F.col("ok"), F.col("captured_at"))})
    told = [name for name in OUTCOME.fieldNames() if name != "url"]
    return rows.select(*PRODUCT.fieldNames(), *told, "at", "ok")
