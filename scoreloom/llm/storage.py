"""Intermediate tables of this subpackage, and how much of a table a task holds at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from scoreloom.scratch import materialise, new_path

__all__ = ["map_batches", "materialise", "new_path"]

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that are sent to Python at once, in place of Spark's 64 MB: buffers double as they grow, on both sides.
MAX_BATCH = 4 << 20


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` over batches of about ``MAX_BATCH`` bytes, so that a task's memory does not grow with the texts.
    A session that asks for less, or doesn't say it in bytes, keeps its own limit."""
    conf = df.sparkSession.conf
    limit = re.fullmatch(r"(\d+)b?", conf.get(BATCH_BYTES))
    if limit and int(limit[1]) > MAX_BATCH:
        conf.set(BATCH_BYTES, str(MAX_BATCH))
    return df.mapInArrow(function, schema)
