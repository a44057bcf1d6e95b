"""Outcome rows instead of exceptions: gate pages, error stages, attempt choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import outcomes as fn
from shelfmark.operators.grouping import first_per
from shelfmark.operators.hits import extract_hits
from shelfmark.rules import GATE_RULES, Rule
from shelfmark.schemas import OUTCOME


def page_quality(pages: DataFrame, *, keep: tuple[str, ...] = ("url",), rules: Sequence[Rule] = GATE_RULES) -> DataFrame:
    """``keep`` columns plus the gate flag of each captured page."""
    hits = extract_hits(pages, rules, keep=keep)
    return hits.select(*keep, fn.is_gate(F.col("gate_form"), F.col("gate_input"), F.col("page_title")).alias("is_gate"))


def outcome_columns(table: DataFrame, stage: Column, given: Column) -> DataFrame:
    """Adds stage, reason, hint and message."""
    return (
        table.withColumn("stage", stage)
        .withColumns({"reason": fn.stage_reason(F.col("stage"), given), "hint": fn.stage_hint(F.col("stage"))})
        .withColumn("message", fn.message(F.col("stage"), F.col("reason"), F.col("url"), F.col("hint")))
    )


def fetch_outcomes(fetch_log: DataFrame) -> DataFrame:
    """OUTCOME rows of the failed fetches in FETCH_LOG."""
    failed = fetch_log.where(F.col("error").isNotNull() | F.col("error_type").isNotNull())
    stage = fn.error_stage(F.col("error"), F.col("error_type"), F.col("captcha_seen"))
    return outcome_columns(failed, stage, F.col("error")).select(*OUTCOME.fieldNames())


def choose_attempt(
    attempts: DataFrame, ok: Column, *, keys: Sequence[str] = ("url",), first: Sequence[Column] = ()
) -> DataFrame:
    """One row per key: the first good attempt, or else the last one.  Adds ``ok``; ``first`` goes before the attempt."""
    order = [
        F.col("ok").desc(),
        *first,
        F.when(F.col("ok"), F.col("attempt")).otherwise(-F.col("attempt")),
        F.col("captured_at").desc_nulls_last() if "captured_at" in attempts.columns else F.lit(0),
    ]
    return first_per(attempts.withColumn("ok", ok), keys, order)
