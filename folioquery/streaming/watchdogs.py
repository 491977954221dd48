"""Sessions under watchdogs: one attempt at a time for each key, and every wait in it has a limit.

An attempt waits for its begin (START), then for words (LISTEN; each one starts the wait anew), and after a stop for its end
(FINAL). A wait that runs out ends the attempt, or, while listening, stops it. What an attempt says after it was given up,
replaced or cancelled is stale: it carries that attempt's number, and is ignored. Events are worked on in the order of time
once the watermark has passed them, together with the waits that ran out between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# How long an attempt waits, in milliseconds; states and errors by name.
START_LIMIT, LISTEN_LIMIT, FINAL_LIMIT = 8_000, 20_000, 6_000
IDLE, STARTING, LISTENING, PROCESSING, FAILED = "IDLE", "STARTING", "LISTENING", "PROCESSING", "FAILED"
NO_RESPONSE, NO_MATCH = "NO_RESPONSE", "NO_MATCH"
BUSY = {STARTING, LISTENING, PROCESSING}


@dataclass(frozen=True)
class Session:
    """attempt: the number of the newest one; due: when the wait of its state runs out (0: nothing is waited for)."""

    state: str = IDLE
    attempt: int = 0
    text: str = ""
    due: int = 0


def ran_out(session: Session) -> Session:
    """What a wait that runs out makes of a session."""
    if session.state == LISTENING:
        return replace(session, state=PROCESSING, due=session.due + FINAL_LIMIT)
    return Session(FAILED, session.attempt + 1, NO_RESPONSE)


def told(session: Session, at: int, event: str, attempt: int | None, text: str) -> Session:
    """What an event makes of a session. The user's: start, stop, cancel, dismiss; an attempt's own, by its number: ready, partial, final, error."""
    if event == "start":
        return session if session.state in BUSY else Session(STARTING, session.attempt + 1, "", at + START_LIMIT)
    if event == "stop":
        return replace(session, state=PROCESSING, due=at + FINAL_LIMIT) if session.state == LISTENING else session
    if event == "cancel":
        return Session(IDLE, session.attempt + 1)
    if event == "dismiss":
        return replace(session, state=IDLE, text="") if session.state == FAILED else session
    if attempt != session.attempt:
        return session
    if event == "ready":
        return Session(LISTENING, attempt, "", at + LISTEN_LIMIT)
    if event == "partial":
        return replace(session, text=text) if session.state == PROCESSING else Session(LISTENING, attempt, text, at + LISTEN_LIMIT)
    if event == "final":
        return Session(IDLE, attempt, text) if text.strip() else Session(FAILED, attempt, NO_MATCH)
    return Session(FAILED, attempt, text) if event == "error" else session


def steps(session: Session, events: list[tuple[int, str, int | None, str]], until: int) -> Iterator[tuple[int, str, Session]]:
    """(when, why, the session from then on) of each change until a time; events in their order, none later than that."""
    for at, event, attempt, text in [*events, (until, "", None, "")]:
        # What runs out at the very time of an event ran out first.
        while session.due and session.due <= at:
            when, session = session.due, ran_out(session)
            yield when, "watchdog", session
        new = told(session, at, event, attempt, text) if event else session
        if new != session:
            session = new
            yield at, event, session


class Watchdogs(StatefulProcessor):
    """Rows (key, at in milliseconds, entry, event, attempt, text) become (key, at, why, state, attempt, text), one for each change of a session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "state string, attempt long, text string, due long")
        self.waiting = handle.getMapState("waiting", "at long, entry long", "event string, attempt long, text string")

    def now(self) -> Session:
        return Session(*self.session.get()) if self.session.exists() else Session()

    def arm(self, session: Session) -> None:
        """A timer named `watchdog` at the end of the session's wait, or an earlier one for the next event."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = [k[0] for k in self.waiting.keys()] + ([session.due] if session.due else [])
        if due:
            self.handle.registerTimer(min(due))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row in rows:
            self.waiting.updateValue((row.at, row.entry), (row.event, row.attempt, row.text))
        self.arm(self.now())
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        until, session = timerValues.getCurrentWatermarkInMs(), self.now()
        ready = sorted(tuple(k) for k in self.waiting.keys() if k[0] <= until)
        events = []
        for k in ready:
            event, attempt, text = self.waiting.getValue(k)
            events.append((k[0], event, attempt, text))
            self.waiting.removeKey(k)
        for at, why, session in steps(session, events, until):
            yield Row(key=key[0], at=at, why=why, state=session.state, attempt=session.attempt, text=session.text)
        self.session.update((session.state, session.attempt, session.text, session.due))
        self.arm(session)

    def close(self) -> None:
        pass


def watched(events: DataFrame, key: str, delay: str = "10 seconds") -> DataFrame:
    """Changes of the sessions of a stream of events(at, entry, event, attempt, text, key), in append mode: key, at, why, state, attempt, text.

    entry orders events of one time. Events without a time are left out, null texts are empty, unknown events do nothing; one
    later than `delay` is left out. A session's change is told once the watermark has passed it.
    """
    own = events.select(F.col(key).cast("string").alias("key"), F.col("at").cast("timestamp").alias("time"), F.col("entry").cast("long"), F.coalesce("event", F.lit("")).alias("event"), F.col("attempt").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = own.where("time IS NOT NULL").withWatermark("time", delay).withColumn("at", F.unix_millis("time"))
    found = rows.groupBy("key").transformWithState(statefulProcessor=Watchdogs(), outputStructType="key string, at long, why string, state string, attempt long, text string", outputMode="append", timeMode="eventTime")
    return found.select(F.col("key").alias(key), F.timestamp_millis("at").alias("at"), "why", "state", "attempt", "text")
