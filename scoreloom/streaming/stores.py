"""Running totals of a stream in a table, exactly once.

Each micro-batch is summed by key, added to what the table has for those keys, and the parts it touches are replaced. The manifest
that does so also notes the batch. A batch that is replayed after a failure, before or after that commit, is found done or has
left no trace, so every row counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from scoreloom.sources import versions


def add_batch(path: str, stream: str, keys: dict[str, Column], sums: dict[str, Column], part: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: adds ``sums`` by ``keys`` to the table at ``path``. ``part``, one of the keys, says which rows are rewritten
    together. Rows with null keys have totals of their own; null values count 0. A batch without rows notes itself only."""
    if part not in keys:
        raise ValueError("the part is one of the keys")

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = versions.manifest(path)
        if now.done.get(stream, -1) >= number:
            return
        new = batch.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in sums.items()])
        new.persist()
        try:
            touched = [r[part] for r in new.select(F.col(part).cast("string")).distinct().toLocalIterator()]  # the parts of one batch
            held = versions.read(spark, path, now.version, touched) if now.version else None
            both = new if held is None else held.select(*new.columns).unionByName(new)
            total = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
            # A writer besides this stream may have replaced such a part: then the batch is summed again from the newer version.
            try:
                versions.replace_parts(total, path, part, seen=now.version, batch=(stream, number))
            except versions.Conflict:
                add(batch, number)
        finally:
            new.unpersist()

    return add


def total_into(events: DataFrame, path: str, stream: str, keys: dict[str, Column], sums: dict[str, Column], part: str) -> DataStreamWriter:
    """A stream writer that keeps totals of ``events`` in a table. Late rows are added to their day like all others."""
    return events.writeStream.foreachBatch(add_batch(path, stream, keys, sums, part))


def usage_into(calls: DataFrame, path: str, stream: str, ts: str, tokens_in: str, tokens_out: str, kind: str) -> DataStreamWriter:
    """Calls and tokens of each day and kind of call; a part is a day."""
    keys = {"day": F.date_format(ts, "yyyy-MM-dd"), "kind": F.col(kind)}
    sums = {"calls": F.lit(1), "tokens_in": F.col(tokens_in), "tokens_out": F.col(tokens_out), "tokens_total": F.coalesce(tokens_in, F.lit(0)) + F.coalesce(tokens_out, F.lit(0))}
    return total_into(calls, path, stream, keys, sums, "day")


def sliding_into(events: DataFrame, path: str, stream: str, ts: str, key: str, length: str = "60 seconds", step: str = "1 second") -> DataStreamWriter:
    """Events of each key in overlapping windows; a part is the hour in which a window begins."""
    w = F.window(ts, length, step)
    placed = events.select(key, w.alias("w")).select(key, F.col("w.start").alias("began"))
    keys = {"hour": F.date_format("began", "yyyy-MM-dd HH"), "began": F.col("began"), key: F.col(key)}
    return total_into(placed, path, stream, keys, {"n": F.lit(1)}, "hour")
