"""Sessions that go through ordered steps, over time: keyed state with timers of event time.

An event waits in its session's state until the watermark has passed it, and is then applied in the order of event time. So the order of
arrival, within what the watermark allows, makes no difference. A session that rests too long is closed and forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "session string, at timestamp, step int, furthest int, finished boolean, repeats long, refused long, expired boolean"
_HELD = "step int, furthest int, repeats long, refused long, last long"
_WAITING = "micros long, name string"


class SessionSteps(StatefulProcessor):
    """Applies events ``(micros, name)``: a step is taken when the one before it has been taken once; taking one again counts as a repeat and
    goes back to it. The first step begins a session anew. Others are refused."""

    def __init__(self, steps: tuple[str, ...], idle_s: float):
        self.steps, self.idle = steps, int(idle_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new, at = [], set()
        for r in rows:
            new.append((r["micros"], r["name"]))
            at.add(r["micros"] // 1000 + 1)
        if new:
            self.waiting.appendList(new)
        for t in at:
            self.handle.registerTimer(t)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        pending = sorted((r[0], self._place(r[1]), r[1]) for r in self.waiting.get())
        ripe = [(t, name) for t, _, name in pending if t < due]
        state = tuple(self.held.get()) if self.held.exists() else None
        out = []
        if ripe:
            rest = [(t, name) for t, _, name in pending if t >= due]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            for t, name in ripe:
                if state is not None and t > state[4] + self.idle:  # its time was up before this event
                    out.append(self._row(key, state[4] + self.idle, state, True))
                    state = None
                state = self._apply(state, t, name)
                out.append(self._row(key, t, state, False))
            self.held.update(state)
            self.handle.registerTimer((state[4] + self.idle) // 1000 + 1)
        elif state is not None and due > state[4] + self.idle:
            self.held.clear()
            out.append(self._row(key, state[4] + self.idle, state, True))
        return iter(out)

    def _place(self, name: str | None) -> int:
        return self.steps.index(name) if name in self.steps else len(self.steps)

    def _apply(self, state, at: int, name: str | None) -> tuple:
        step, furthest, repeats, refused, _ = state or (0, 0, 0, 0, at)
        k = self._place(name) + 1
        if k > len(self.steps) or k > furthest + 1:
            refused += 1
        elif k == 1:
            step, furthest, repeats = 1, 1, repeats + (furthest > 0)
        else:
            step, furthest, repeats = k, max(k, furthest), repeats + (k <= furthest)
        return step, furthest, repeats, refused, at

    def _row(self, key, at: int, state, expired: bool) -> Row:
        return Row(
            session=key[0], at=datetime.fromtimestamp(at // 1_000_000) + timedelta(microseconds=at % 1_000_000), step=state[0], furthest=state[1],
            finished=state[1] == len(self.steps), repeats=state[2], refused=state[3], expired=expired,
        )


def session_log(events: DataFrame, session: str, ts: str, step: str, steps: tuple[str, ...], idle_s: float, late: str = "1 minute") -> DataFrame:
    """What each event of a stream made of its session, and one row for each session whose time is up (``expired``); append mode.

    ``step``: where the session stands; ``furthest``: how far it has come since it began; ``refused``: events out of turn or of no known step. The
    time is up ``idle_s`` after the last event. Events of one time count in the order of ``steps``. Later than ``late`` behind the newest event
    means left out. Null sessions are one session named ''; null times are left out. Needs the RocksDB state store, which the session's
    configuration has to name.
    """
    conf = events.sparkSession.conf
    if conf.get(STATE_STORE, "") != ROCKS_DB:
        raise ValueError(f"set {STATE_STORE} to {ROCKS_DB}")
    rows = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(
        F.coalesce(F.col(session).cast("string"), F.lit("")).alias("session"), F.col(ts), F.unix_micros(ts).alias("micros"), F.col(step).cast("string").alias("name")
    )
    return rows.groupBy("session").transformWithState(SessionSteps(steps, idle_s), OUTPUT, "append", "eventTime")
