"""Structured Streaming forms of the running counters. Each works on batch frames as well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task_progress(events: DataFrame, task: str, done: str) -> DataFrame:
    """Counters of each task; use with update mode."""
    return events.groupBy(task).agg(F.count("*").alias("seen"), F.count_if(F.col(done)).alias("done"))


def daily_totals(calls: DataFrame, ts: str, value: str, late: str = "1 day") -> DataFrame:
    """Totals of each day; rows later than ``late`` are left out on a stream."""
    day = F.window(ts, "1 day")
    return calls.withWatermark(ts, late).groupBy(day).agg(F.count("*").alias("calls"), F.sum(value).alias("total")).select(F.to_date("window.start").alias("day"), "calls", "total")


def sliding_counts(events: DataFrame, ts: str, key: str, length: str = "60 seconds", step: str = "1 second", late: str = "2 minutes") -> DataFrame:
    """Events of each key in overlapping windows."""
    w = F.window(ts, length, step)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("began"), key, "n")


def session_steps(events: DataFrame, session: str, step: str, steps: tuple[str, ...]) -> DataFrame:
    """How far each session has come: the last of ``steps`` (1 and up, in order) that it has reached with all those
    before it, and whether that is the final one; use with update mode. Other steps and repeats change nothing."""
    reached = [F.count_if(F.col(step) == name) > 0 for name in steps]
    upto = [reduce(Column.__and__, reached[:k]).cast("int") for k in range(1, len(steps) + 1)]
    done = reduce(Column.__add__, upto)
    return events.groupBy(session).agg(done.cast("int").alias("step"), (done == len(steps)).alias("finished"))
