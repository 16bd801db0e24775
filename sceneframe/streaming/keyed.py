"""Keyed state of the engine's own: events of a key in their order, and timers in event time.

State lives in the engine's state store, so a batch reads and writes the state of the keys it
touches, and a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import Row

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession):
    """While a query is started: the state store that holds lists and timers."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class InOrder(StatefulProcessor):
    """Hands the events of a key to ``event`` one by one in the order of ``at_us, event_id``.

    Events may arrive in any order within the watermark: they wait in state until the
    watermark has passed them. ``due`` tells when time alone changes a key's state, and
    ``moment`` is called when the watermark has passed that; a key that has been quiet for
    ``quiet_us`` is forgotten. Subclasses name ``STATE``, the columns of a key's state with
    ``last_us`` among them, and ``NEW``, its first value.
    """

    STATE: str
    NEW: dict

    def __init__(self, quiet_us: int):
        self.quiet_us = quiet_us

    def event(self, key: tuple, state: dict, row: Row) -> Iterator[Row]:
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        return None

    def moment(self, key: tuple, state: dict, now_us: int) -> Iterator[Row]:
        return iter(())

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_us bigint, event_id bigint, refused boolean")
        self.kept = handle.getValueState("kept", self.STATE)
        self.columns = [c.split()[0] for c in self.STATE.split(", ")]

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(-(-at_us // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        if key[0] is not None:  # rows without a key only move time on
            fresh = []
            for row in rows:
                fresh.append((row["at_us"], row["event_id"], row["refused"]))
                first = row["at_us"] if first is None else min(first, row["at_us"])
                if len(fresh) == 1000:
                    self.waiting.appendList(fresh)
                    fresh = []
            if fresh:
                self.waiting.appendList(fresh)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not (self.waiting.exists() or self.kept.exists()):
            return  # a timer of a key that has been forgotten
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in held if r[0] <= now_us]
        state = dict(zip(self.columns, self.kept.get())) if self.kept.exists() else dict(self.NEW)
        for at_us, event_id, refused in ready:
            state["last_us"] = at_us
            yield from self.event(key, state, Row(at_us=at_us, event_id=event_id, refused=refused))
        yield from self.moment(key, state, now_us)
        rest = held[len(ready):]
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if not rest and state["last_us"] is not None and now_us - state["last_us"] >= self.quiet_us:
            self.waiting.clear()
            self.kept.clear()
            return
        self.kept.update(tuple(state[c] for c in self.columns))
        if rest:
            self._wake(rest[0][0])
        if (next_us := self.due(state)) is not None and next_us > now_us:
            self._wake(next_us)
        if state["last_us"] is not None:
            self._wake(state["last_us"] + self.quiet_us)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, processor: InOrder, schema: str, watermark: str) -> DataFrame:
    """A stream of ``key, event_id, at, refused`` through a processor, a row for whatever it tells.

    Events later than the watermark are dropped, as the engine does everywhere. Rows whose
    key is null are no events: they move the watermark on.
    """
    rows = events.withWatermark("at", watermark).select(key, "at", "event_id", "refused", F.unix_micros("at").alias("at_us"))
    return rows.groupBy(key).transformWithState(processor, schema, "append", "EventTime")
