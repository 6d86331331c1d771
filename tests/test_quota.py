"""One quota for all tasks: by a fake clock, and in a barrier stage."""

import os
import random
import threading
import time

import pytest

from scoreloom.sources.models import EchoClient, RateLimited
from scoreloom.sources.quota import Quota, Turn, ask_within, deal, places


def test_shares_use_all_calls_that_are_wanted():
    rng = random.Random(1)
    for _ in range(500):
        wants = [rng.choice((0, 1, 3, 50)) for _ in range(rng.randrange(1, 9))]
        calls = rng.randrange(0, 60)
        shares = deal(wants, calls)
        assert sum(shares) == min(calls, sum(wants)) and all(s <= w for s, w in zip(shares, wants, strict=True))
        full = [s for s, w in zip(shares, wants, strict=True) if s < w]
        assert not full or max(full) - min(full) <= 1  # no one who wants more has less than another by two
        assert sorted(p for k in range(len(wants)) for p in places(shares, k)) == list(range(sum(shares)))


class Clocks:
    """A clock for each task; whoever sleeps is later, and all meet at the latest."""

    def __init__(self, n):
        self.times, self.told, self.barrier = [0.0] * n, [""] * n, threading.Barrier(n, action=self.meet)

    def meet(self):
        self.times = [max(self.times)] * len(self.times)

    def of(self, k):
        def gather(message):
            self.told[k] = message
            self.barrier.wait(20)
            told = list(self.told)
            self.barrier.wait(20)
            return told

        def sleep(seconds):
            self.times[k] += seconds

        return gather, lambda: self.times[k], sleep


@pytest.mark.parametrize("per_minute, spacing, span, last", [(120, 0.0, 1.0, 0.2), (600, 0.05, 1.0, 0.01), (30, 0.0, 1.0, 3.0), (5, 1.0, 1.0, 0.5), (3000, 0.1, 2.0, 0.3), (2, 0.0, 1.0, 1.0)])
def test_eight_tasks_stay_under_one_limit(per_minute, spacing, span, last):
    clocks, calls, lock = Clocks(8), [], threading.Lock()
    amounts = [60 if per_minute > 50 else 4, 0, 5, 1, 30 if per_minute > 50 else 2, 5, 0, 2]

    def task(k):
        gather, clock, sleep = clocks.of(k)
        turn, rng = Turn(Quota(per_minute, spacing, span, k, gather, clock, sleep)), random.Random(k)
        for at in range(amounts[k]):
            turn.wants = amounts[k] - at
            turn.wait()
            with lock:
                calls.append(clock())
            sleep(rng.random() * 2 * last)
            if k == 2 and at == 3:
                turn.rest_for(30.0)
        turn.finish()

    threads = [threading.Thread(target=task, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join(60) for t in threads]
    assert len(calls) == sum(amounts)
    calls.sort()
    assert max(sum(a <= t < a + 60 for t in calls) for a in calls) <= per_minute
    assert all(b - a >= spacing - 1e-9 for a, b in zip(calls, calls[1:]))
    assert max(b - a for a, b in zip(calls, calls[1:])) >= 29  # everyone rested


def test_barrier_stage_keeps_the_quota(spark, tmp_path):
    folder = str(tmp_path)

    class Noting(EchoClient):
        def complete(self, prompt, temperature, max_tokens):
            with open(f"{folder}/{prompt}-{os.getpid()}-{time.monotonic_ns()}", "w"):
                pass
            if prompt == "limited" and not [x for x in os.listdir(folder) if x == "once"]:
                open(f"{folder}/once", "w").close()
                raise RateLimited(0.5)
            return super().complete(prompt, temperature, max_tokens)

    rows = [(i, f"p{i}", 1) for i in range(24)] + [(98, "limited", 1), (99, None, 1)]
    df = spark.createDataFrame(rows, "id long, p string, k int")
    got = ask_within(df, "p", lambda model: Noting(), per_minute=600, spacing=0.02, span=0.5, tasks=4)
    found = {r["id"]: r for r in got.collect()}
    assert all(found[i]["reply"] == f"p{i}" and found[i]["reply_error"] is None for i in range(24)) and found[98]["reply"] == "limited" and found[99]["reply_error"] == "no prompt"
    times = sorted(int(x.rsplit("-", 1)[1]) / 1e9 for x in os.listdir(folder) if "-" in x)
    assert len(times) == 26 and len({x.split("-")[1] for x in os.listdir(folder) if "-" in x}) == 4
    assert max(sum(a <= t < a + 0.5 for t in times) for a in times) <= 2 * 600 // 122 + 1
    assert ask_within(df.limit(0), "p", lambda model: Noting(), per_minute=600, tasks=2).count() == 0


def test_tasks_hold_a_part_of_a_batch_as_texts(spark):
    import pyarrow as pa

    from scoreloom.sources import models

    class Frame:
        schema = spark.range(0).selectExpr("id", "'' AS p").schema
        columns = ["id", "p"]

        def mapInArrow(self, run, schema):
            return run

    calls = []

    class Counting(EchoClient):
        def complete(self, prompt, temperature, max_tokens):
            calls.append(prompt)
            return super().complete(prompt, temperature, max_tokens)

    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "p": [f"p{k}" for k in range(1000)]})
    out = models.ask(Frame(), "p", Counting)(iter([batch]))
    first = next(out)
    assert len(calls) == first.num_rows == models.ROWS_AT_HAND
    rest = pa.Table.from_batches([first, *out])
    assert rest.column("reply").to_pylist() == rest.column("p").to_pylist() == batch.column("p").to_pylist() and rest.column("reply_error").null_count == 1000


def test_quota_over_many_parts(spark):
    """More rows a task than a part has, of several models and with nulls."""

    class Named:
        def __init__(self, model):
            self.model = model

        def complete(self, prompt, temperature, max_tokens):
            return {"content": f"{self.model}: {prompt}", "finish_reason": "stop"}

    df = spark.range(1500).selectExpr("id", "CASE WHEN id % 7 > 0 THEN concat('p', id) END AS p", "CASE WHEN id % 3 > 0 THEN concat('m', id % 3) END AS m", "array(id) AS a", "timestamp_seconds(id) AS t")
    got = ask_within(df, "p", lambda model: Named(model), per_minute=6_000_000, model="m", tasks=2, limit_s=None).collect()
    assert sorted(r["id"] for r in got) == list(range(1500))
    for r in got:
        i = r["id"]
        assert r["reply"] == (f"{f'm{i % 3}' if i % 3 else None}: p{i}" if i % 7 else None) and r["reply_error"] == (None if i % 7 else "no prompt") and r["a"] == [i]
