"""The time-to-live rule for repeats, exactly, in a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from shelfmark.streaming.keyed import packed, unpacked, with_state


class _Repeats(StatefulProcessor):
    """Captures wait for the watermark and are then taken in the order of their times. Holds the time of the last one
    that came out, until its time to live is over, and the captures that the watermark has not passed."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "held string")

    def _expired(self, last: int | None, at: int) -> bool:
        return last is None or at - last > self.ttl_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if any(part is None for part in key):
            for _ in rows:
                pass
            return iter(())
        old = self.state.get()
        held = json.loads(old[0]) if old is not None else {"last": None, "wait": []}
        first = held["wait"][0][0] if held["wait"] else None
        # What lies within the last one's time to live is a repeat already; of one instant the least payload counts.
        new = {at: payload for at, payload in sorted(((r["at_us"], r["payload"]) for r in rows), reverse=True) if self._expired(held["last"], at)}
        for at, payload in held["wait"]:
            new[at] = min(payload, new.get(at, payload))
        held["wait"] = sorted(new.items())
        if held["wait"] and (first is None or held["wait"][0][0] < first):
            self.handle.registerTimer(-(-held["wait"][0][0] // 1000))
        self.state.update((json.dumps(held),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.state.get()
        if old is None:
            return
        held, now = json.loads(old[0]), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        passed = [entry for entry in held["wait"] if entry[0] <= now]
        wait = [entry for entry in held["wait"] if entry[0] > now]
        for at, payload in passed:
            if self._expired(held["last"], at):
                held["last"] = at
                yield Row(**key.asDict(), payload=payload)
        held["wait"] = [entry for entry in wait if self._expired(held["last"], entry[0])]
        if held["wait"]:
            self.handle.registerTimer(-(-held["wait"][0][0] // 1000))
        elif held["last"] is not None and held["last"] + self.ttl_us > now:
            self.handle.registerTimer((held["last"] + self.ttl_us) // 1000 + 1)  # to forget it
        else:
            self.state.clear()
            return
        self.state.update((json.dumps(held),))

    def close(self) -> None:
        pass


def without_repeats(rows: DataFrame, keys: Sequence[str], *, ttl_seconds: int, time: str = "captured_at", delay: str = "0 seconds") -> DataFrame:
    """The rows of a stream without repeats: of a key's rows, in the order of their times, one comes out if more than
    ``ttl_seconds`` have passed since the last one that came out.

    The rule is that of stored pages (exactly as old as its time to live is still valid). A row comes out once the watermark, ``delay`` behind the newest time, has
    passed its time; rows that come later than that are left out. Of rows with one key and time one counts, always the same. A row
    without a key or time gives nothing. State per key: one time while its time to live runs, and the rows within ``delay``.
    """
    kept = T.StructType([field for field in rows.schema.fields if field.name not in keys])
    timed = rows.where(F.col(time).isNotNull()).withColumns({"at_us": F.unix_micros(time), "event_at": F.col(time)})
    timed = packed(timed.withWatermark("event_at", delay), kept.fieldNames())
    named = T.StructType([*(rows.schema[name] for name in keys), T.StructField("payload", T.StringType())])
    return unpacked(with_state(timed, keys, _Repeats(ttl_seconds * 1_000_000), named), kept).select(*rows.columns)
