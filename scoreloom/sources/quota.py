"""One quota of calls for all tasks of a job.

The tasks of a barrier stage run at the same time. Before each span of time they tell one another, by ``allGather``, how many calls they
have at hand and how long their provider asks to wait; every task works out the same deal of the span's calls from that, and
makes its own share at its own places in the span. No server is asked and nothing is shared but the messages, and a
share that one task has no use for goes to the others at once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame

from scoreloom.sources.models import TEMPERATURES, Client, RateLimited, exchange, parts, with_texts


def deal(wants: list[int], calls: int) -> list[int]:
    """``calls`` dealt evenly among tasks that want so many each; what is left over goes to those that want more, by number."""
    shares, open_ = [0] * len(wants), [k for k, w in enumerate(wants) if w > 0]
    while calls > 0 and open_:
        each, extra = divmod(calls, len(open_))
        for place, k in enumerate(open_):
            got = min(wants[k] - shares[k], each + (place < extra))
            shares[k] += got
            calls -= got
        open_ = sorted((k for k in open_ if shares[k] < wants[k]), key=lambda k: (shares[k], k))
    return shares


def places(shares: list[int], task: int) -> list[int]:
    """A task's places among all calls of a span. Tasks take turns, so that each has calls all over the span."""
    turn = sorted((n, k) for k, s in enumerate(shares) for n in range(s))
    return [at for at, (_, k) in enumerate(turn) if k == task]


class Quota:
    """A quota of calls a minute, and of time between any two calls of the job, for one task of a barrier stage.

    A span begins when all tasks have told what they want, and the next one when all have made, or given up, their calls. So many
    spans as can touch a minute hold ``per_minute`` calls together at most.
    """

    def __init__(self, per_minute: int, spacing: float, span: float, task: int, gather: Callable[[str], list[str]], clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if per_minute < 2 or span <= 0 or spacing < 0:
            raise ValueError("a quota needs two calls a minute, a span of time and a spacing of 0 or more")
        self.task, self.gather, self.clock, self.sleep = task, gather, clock, sleep
        spans = int(60.0 // span) + 2
        if per_minute < spans:  # not one call a span: fewer spans, so that each has one
            span = 60.0 / (per_minute - 1)
            spans = int(60.0 // span) + 2
            while spans > per_minute:
                span *= 1.01
                spans = int(60.0 // span) + 2
        self.calls = max(1, per_minute // spans)
        self.gap = max(spacing / 0.9, span / self.calls)
        #: How late a call may begin, so that the spacing holds; without one, as late as it will: its span lasts until then.
        self.slack = self.gap / 10 if spacing > 0 else float("inf")
        self.span = max(span, self.gap * self.calls)

    def leases(self, wants: int, pause: float) -> tuple[float, list[float]] | None:
        """The end of the next span, and when this task may call in it, by its own clock; None once no task wants a call."""
        told = [json.loads(x) for x in self.gather(json.dumps([wants, pause]))]
        if not any(w for w, _ in told):
            return None
        began = self.clock() + max(p for _, p in told)
        shares = deal([w for w, _ in told], self.calls)
        return began + self.span, [began + self.gap * at for at in places(shares, self.task)]

    def until(self, when: float) -> None:
        while (left := when - self.clock()) > 0:
            self.sleep(left)


class Turn:
    """Stands in for a pace: waits for the next lease, through further spans while none is at hand. Where calls are spaced, leases that
    a long call has outlasted are given up."""

    def __init__(self, quota: Quota):
        self.quota, self.left, self.pause, self.end, self.wants = quota, [], 0.0, None, 1

    def _next_span(self, wants: int) -> bool:
        if self.end is not None:
            self.quota.until(self.end)
        pause, self.pause = self.pause, 0.0
        found = self.quota.leases(wants, pause)
        if found is None:
            return False
        self.end, self.left = found
        return True

    def wait(self) -> None:
        while True:
            while not self.left:
                self._next_span(self.wants)
            when = self.left.pop(0)
            if self.quota.clock() <= when + self.quota.slack:
                return self.quota.until(when)

    def rest_for(self, seconds: float) -> None:
        """The provider asks to wait: this task's leases are given up, and the next span begins so much later for all tasks."""
        self.pause, self.left = max(self.pause, seconds), []

    def finish(self) -> None:
        """Takes part until no task wants a call."""
        while self._next_span(0):
            self.left = []


class _Heeding:
    """A client whose request to wait is heeded by all tasks."""

    def __init__(self, client: Client, turn: Turn):
        self.client, self.turn = client, turn

    def complete(self, prompt: str, temperature: float, max_tokens: int) -> dict:
        try:
            return self.client.complete(prompt, temperature, max_tokens)
        except RateLimited as limited:
            self.turn.rest_for(limited.retry_after)
            raise RuntimeError(str(limited)) from limited  # the pause is everyone's: exchange itself need not wait it out


def ask_within(df: DataFrame, prompt: str, client: Callable[[str | None], Client], per_minute: int, spacing: float = 0.0, span: float = 1.0, kind: str = "analyse", model: str | None = None, name: str = "reply", tasks: int | None = None, attempts: int = 3, limit_s: float | None = 180.0) -> DataFrame:
    """Adds ``name`` and ``<name>_error``; all tasks together make at most ``per_minute`` calls in any minute, ``spacing`` apart at least.

    ``tasks`` of them run at once and have to find free slots at the same time. A null prompt is not asked. Rows are dealt out evenly, so
    a common key makes no task longer. Write the result before using it twice, or ask through a ledger: a barrier stage
    that loses one task begins again with all.
    """
    n = tasks or df.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        turn = Turn(Quota(per_minute, spacing, span, context.partitionId(), context.allGather))
        makers: dict[str | None, Client] = {}
        for batch in batches:
            for before, part in parts(batch):
                said: list[tuple[str | None, str | None]] = []
                for at, text in enumerate(part.column(prompt), before):
                    if not text.is_valid:
                        said.append((None, "no prompt"))
                        continue
                    which = part.column(model)[at - before].as_py() if model else None
                    if which not in makers:
                        makers[which] = _Heeding(client(which), turn)
                    turn.wants = batch.num_rows - at
                    found = exchange(makers[which], text.as_py(), TEMPERATURES[kind], turn, attempts, lambda s: None, limit_s)
                    said.append((found["reply"], found["error"]))
                yield with_texts(part, **{name: [r for r, _ in said], f"{name}_error": [e for _, e in said]})
        turn.finish()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(n).mapInArrow(run, f"{fields}, `{name}` string, `{name}_error` string", barrier=True)
