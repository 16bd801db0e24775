"""The throttle monitor: streaks of refusals, when patience runs out, and when to announce them.

Both follow the events of a run in their order, out of the engine's keyed state, and are told
of the time by event-time timers; see ``keyed``. What they tell is only ever appended, so a
batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from sceneframe import constants as C
from sceneframe.operators import activity
from sceneframe.streaming import sinks
from sceneframe.streaming.keyed import InOrder, in_order, keyed_store

#: How late an event may be, and how long a run is quiet before its state is dropped.
WATERMARK, QUIET_DAYS = "10 minutes", 90

_SECOND, _DAY = 1_000_000, 86_400_000_000

EPISODE = ("run_id bigint, episode bigint, started timestamp, ended timestamp, refusals bigint, spoken_any boolean, "
           "last_wait bigint, waited bigint, gave_up boolean")
#: ``what`` is going, closed or gave_up; ``turn`` orders what is told about a run.
TOLD = "run_id bigint, turn bigint, what string, at_us bigint, episode bigint, started_us bigint, ended_us bigint, refusals bigint, spoken_any boolean"
ANNOUNCED = "run_id bigint, event_id bigint, at timestamp, episode bigint"


class Monitor(InOrder):
    """Streaks of a run: going on at every refusal, given up when patience runs out, closed by an answer."""

    STATE = ("episode bigint, started_us bigint, ended_us bigint, refusals bigint, spoken_any boolean, given_up boolean, "
             "turn bigint, last_us bigint")
    NEW = {"episode": 0, "started_us": None, "ended_us": None, "refusals": 0, "spoken_any": False, "given_up": False, "turn": 0, "last_us": None}

    def _tell(self, key, state: dict, what: str, at_us: int) -> Row:
        state["turn"] += 1
        return Row(run_id=key[0], turn=state["turn"], what=what, at_us=at_us, **{c: state[c] for c in ("episode", "started_us", "ended_us", "refusals", "spoken_any")})

    def due(self, state):
        if state["started_us"] is None or state["given_up"]:
            return None
        patience = C.PATIENCE_SECONDS if state["spoken_any"] else C.PATIENCE_COLD_SECONDS
        return state["started_us"] + patience * _SECOND

    def moment(self, key, state, now_us) -> Iterator[Row]:
        limit = self.due(state)
        if limit is not None and limit <= now_us:
            state["given_up"] = True
            yield self._tell(key, state, "gave_up", limit)

    def event(self, key, state, row) -> Iterator[Row]:
        yield from self.moment(key, state, row.at_us)
        if not row.refused:
            if state["started_us"] is not None:
                yield self._tell(key, state, "closed", row.at_us)
            state.update(started_us=None, ended_us=None, refusals=0, spoken_any=True, given_up=False)
            return
        if state["started_us"] is None:
            state.update(episode=state["episode"] + 1, started_us=row.at_us)
        state.update(refusals=state["refusals"] + 1, ended_us=row.at_us)
        yield self._tell(key, state, "going", row.at_us)


class Announcer(InOrder):
    """Refusals worth telling somebody about: a new episode, at most one in ten minutes."""

    STATE = "episode bigint, streak boolean, told_episode bigint, told_us bigint, last_us bigint"
    NEW = {"episode": 0, "streak": False, "told_episode": None, "told_us": None, "last_us": None}

    def event(self, key, state, row) -> Iterator[Row]:
        if not row.refused:
            state["streak"] = False
            return
        if not state["streak"]:
            state.update(streak=True, episode=state["episode"] + 1)
        told = state["told_us"]
        if told is None or (state["told_episode"] != state["episode"] and row.at_us - told >= C.ANNOUNCE_SECONDS * _SECOND):
            state.update(told_episode=state["episode"], told_us=row.at_us)
            yield Row(run_id=key[0], event_id=row.event_id, at_us=row.at_us, episode=state["episode"])


def _service(events: DataFrame) -> DataFrame:
    # A row that says neither still tells the time.
    silent = ~(F.coalesce("refused", F.lit(False)) | F.coalesce("answered", F.lit(False)))
    return events.select(F.when(~silent, F.col("run_id")).alias("run_id"), "event_id", "at", F.coalesce("refused", F.lit(False)).alias("refused"))


def watch(events: DataFrame, watermark: str = WATERMARK, quiet_days: int = QUIET_DAYS) -> DataFrame:
    """A stream of ``run_id, event_id, at, refused, answered`` as what the monitor tells of it."""
    return in_order(_service(events), "run_id", Monitor(quiet_days * _DAY), TOLD, watermark)


def episodes(told: DataFrame) -> DataFrame:
    """Every episode as it was last told, open ones too."""
    seen = told.filter("what IN ('going', 'closed')").groupBy("run_id", "episode").agg(
        F.max_by(F.struct("started_us", "ended_us", "refusals", "spoken_any"), "turn").alias("s"))
    return activity.finished(seen.select(
        "run_id", "episode", F.timestamp_micros("s.started_us").alias("started"), F.timestamp_micros("s.ended_us").alias("ended"),
        "s.refusals", "s.spoken_any"))


def give_ups(told: DataFrame) -> DataFrame:
    """When patience ran out, per episode in which it did."""
    return told.filter("what = 'gave_up'").select("run_id", "episode", F.timestamp_micros("at_us").alias("at"), "refusals")


def monitor(events: DataFrame, folder: str, watermark: str = WATERMARK) -> DataFrame:
    """Drive the monitor over a stream of service events; everything told so far, earlier runs' included."""
    with keyed_store(events.sparkSession):
        return sinks.run_append(watch(events, watermark), folder)


def announcements(events: DataFrame, watermark: str = WATERMARK, quiet_days: int = QUIET_DAYS) -> DataFrame:
    """Announcements of a stream of service events, once each, as soon as the watermark makes them final."""
    told = in_order(_service(events), "run_id", Announcer(quiet_days * _DAY), "run_id bigint, event_id bigint, at_us bigint, episode bigint", watermark)
    return told.select("run_id", "event_id", F.timestamp_micros("at_us").alias("at"), "episode")


def announce(events: DataFrame, folder: str, watermark: str = WATERMARK) -> DataFrame:
    """Drive ``announcements``; all that were made so far."""
    with keyed_store(events.sparkSession):
        return sinks.run_append(announcements(events, watermark), folder)
