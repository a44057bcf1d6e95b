"""Review rounds as a stream: what a reader collects per product, whatever the order of its review pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.reviews import STALL_ROUNDS, extract_reviews
from shelfmark.rules import REVIEW_RULES, Rule
from shelfmark.schemas import REVIEW
from shelfmark.streaming.keyed import Gathering, gathered, milliseconds, only_better, packed, unpacked

_PACKED = T.StructType([field for field in REVIEW.fields if field.name not in ("url", "round", "pos")])
_READ = "url string, round int, pos int, payload string, review_rank int"


class _Reader(Gathering):
    """Holds the first ``max_reviews`` distinct reviews by round and place: none that was pushed out can come back
    but by showing at an earlier place."""

    def __init__(self, keys: Sequence[str], idle_ms: int, max_reviews: int):
        super().__init__(keys, idle_ms)
        self.max_reviews = max_reviews

    def add(self, held: dict, row: dict) -> None:
        place = [row["round"], row["pos"]]
        mark = row["mark"]
        if mark in held and held[mark][0] <= place:
            return
        held[mark] = [place, row["payload"]]
        if len(held) > self.max_reviews:
            del held[max(held, key=lambda m: held[m][0])]

    def result(self, key: tuple, held: dict) -> Iterator[Row]:
        before = 0
        for rank, ((number, pos), payload) in enumerate(sorted(held.values()), 1):
            if number - before > STALL_ROUNDS:
                return
            before = number
            yield Row(url=key[0], round=number, pos=pos, payload=payload, review_rank=rank)


def review_stream(
    pages: DataFrame, max_reviews: int, *, idle: str = "10 minutes", delay: str = "0 seconds", rules: Sequence[Rule] = REVIEW_RULES
) -> DataFrame:
    """What :func:`operators.reviews.top_reviews` gives for each URL of a stream of review pages (url, round, html, captured_at).

    A product's reviews are read once its URL had no review page for ``idle`` of capture time; they come out then, ranked, all at once.
    State per URL: ``max_reviews`` reviews. Rounds count from 1; a review without a round is left out.
    A page without a URL only moves the watermark.
    """
    if max_reviews <= 0:
        raise ValueError("max_reviews counts from 1")
    rows = extract_reviews(pages.withWatermark("captured_at", delay), rules=rules, keep=["captured_at"])
    # One text for (text, date), in which an absent date equals an empty one.
    mark = F.sha2(F.to_json(F.struct("text", F.coalesce("date", F.lit("")).alias("date"))), 256)
    rows = rows.where("round IS NOT NULL").withColumns({"mark": mark, "at_us": F.unix_micros("captured_at"), "by_round": -F.col("round"), "by_pos": -F.col("pos")})
    rows = packed(rows, _PACKED.fieldNames())
    rows = rows.mapInArrow(only_better(["url", "mark"], ["by_round", "by_pos"]), rows.schema).drop("by_round", "by_pos")
    read = gathered(rows, _Reader(["url"], milliseconds(idle), max_reviews), _READ, "captured_at")
    return unpacked(read, _PACKED).select(*REVIEW.fieldNames(), "review_rank")
