"""A ledger of model calls: what was asked once is never asked, or paid, again.

Replies are rows of an append-only Parquet table, keyed by a digest of the kind of call, the model and the prompt. A run asks what
the ledger has no reply to, each distinct prompt once. Its tasks write every reply to a journal in the ledger's folder
before they make the next call. A task that is tried again, on whatever executor, finds there what its earlier attempts
have asked and goes on behind it; a run after a lost driver first brings such journals into the table. Failed calls are
entered with their error and are asked again by the next run only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.scratch import materialise
from scoreloom.sources import files
from scoreloom.sources.models import CALLS_A_MINUTE, TEMPERATURES, Client, Pace, exchange, pace_of

ENTRY = "digest string, kind string, model string, reply string, thinking string, error string, attempts int, at long"
_BETWEEN = "\x1f"


def digest(kind: Column, model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws(_BETWEEN, kind, F.coalesce(model, F.lit("")), prompt).cast("binary"), 256)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the table, failed ones too; none for a ledger that isn't there."""
    return spark.read.schema(ENTRY).parquet(f"{path}/calls") if files.names(f"{path}/calls") else spark.createDataFrame([], ENTRY)


def replies(spark: SparkSession, path: str) -> DataFrame:
    """One entry a digest: its first reply, or the last error."""
    row = F.struct("reply", "thinking", "error", "attempts")
    order = F.struct(F.col("reply").isNotNull(), F.when(F.col("reply").isNotNull(), -F.col("at")).otherwise(F.col("at")))
    return entries(spark, path).groupBy("digest").agg(F.max_by(row, order).alias("x")).select("digest", "x.*")


def recover(spark: SparkSession, path: str) -> int:
    """Bring the journals of runs into the table; entries that are there already are not added twice. Returns the number of runs. Not
    for use while another run writes to the ledger."""
    runs = files.names(f"{path}/journal")
    for run in runs:
        folder = f"{path}/journal/{run}"
        if any(files.names(f"{folder}/{part}") for part in files.names(folder)):
            new = spark.read.schema(ENTRY).json(f"{folder}/*")
            known = entries(spark, path).select("digest", "at")
            new.join(known, ["digest", "at"], "left_anti").write.mode("append").parquet(f"{path}/calls")
        files.remove_folder(folder)
    return len(runs)


def _ask(journal: str, client: Callable[[str | None], Client], attempts: int, every: int, pace: Callable[[], Pace] | None, sleep: Callable[[float], None], limit_s: float | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        own = f"{journal}/{context.partitionId():05d}"
        asked = {json.loads(line)["digest"] for text in files.read_files(own).values() for line in text.splitlines()}
        makers: dict[str | None, tuple[Client, Pace]] = {}
        waiting: list[str] = []
        held = pace() if pace else Pace(CALLS_A_MINUTE, 0.0)
        calls, failed, written = 0, 0, 0

        def write() -> None:
            nonlocal written
            if waiting:
                files.write_file(f"{own}/{context.taskAttemptId()}-{written:06d}.json", "".join(waiting).encode())
                written += 1
                waiting.clear()

        for f in frames:
            for key, kind, model, prompt in zip(f["digest"], f["kind"], f["model"], f["prompt"], strict=True):
                if key in asked:
                    continue
                if model not in makers:
                    made = client(model)
                    makers[model] = made, held if pace or not hasattr(made, "per_minute") else pace_of(made)
                reply = exchange(makers[model][0], prompt, TEMPERATURES[kind], makers[model][1], attempts, sleep, limit_s)
                calls += reply["attempts"]
                failed += reply["reply"] is None
                waiting.append(json.dumps({"digest": key, "kind": kind, "model": model, **reply, "at": time.time_ns() // 1000}) + "\n")
                if len(waiting) >= every:
                    write()
        write()
        yield pd.DataFrame({"calls": [calls], "failed": [failed]})

    return run


def ask_once(
    df: DataFrame,
    prompt: str,
    ledger: str,
    client: Callable[[str | None], Client],
    kind: str = "analyse",
    model: str | None = None,
    name: str = "reply",
    tasks: int | None = None,
    every: int = 1,
    attempts: int = 3,
    pace: Callable[[], Pace] | None = None,
    sleep: Callable[[float], None] = time.sleep,
    limit_s: float | None = 180.0,
) -> DataFrame:
    """``df`` with ``name``, ``<name>_thinking`` and ``<name>_error``: the model's replies to the column ``prompt``.

    ``client`` makes the client of a model in a task; ``model`` is the column that names it. Calls are made here and now; using
    the result makes none. ``ledger`` is a folder that driver and executors share. Replies are journalled ``every`` so many
    calls; with 1, a killed task repeats at most the call it was in. ``pace`` makes the pace of a task; without one, clients that
    state theirs have it, and all others of the task share the usual one. Rows with a null or empty prompt are not asked and have an
    error. Rows that repeat a prompt share its reply. An empty table makes no call.
    """
    spark = df.sparkSession
    recover(spark, ledger)
    which = F.lit(None).cast("string") if model is None else F.col(model).cast("string")
    key = F.when(F.octet_length(prompt) > 0, digest(F.lit(kind), which, F.col(prompt)))
    keyed = materialise(df.withColumn("__digest", key), "asked")
    one = keyed.where("__digest is not null").groupBy(F.col("__digest").alias("digest")).agg(F.first(which).alias("model"), F.first(prompt).alias("prompt"))
    known = replies(spark, ledger).where("reply is not null").select("digest")
    missing = materialise(one.join(known, "digest", "left_anti").select("digest", F.lit(kind).alias("kind"), "model", "prompt"), "to-ask")
    journal = f"{ledger}/journal/{uuid.uuid4().hex}"
    n = tasks or spark.sparkContext.defaultParallelism
    # By digest and into a fixed number of parts, so that another attempt of a task has the same rows.
    dealt = missing.repartition(n, "digest").sortWithinPartitions("digest")
    dealt.mapInPandas(_ask(journal, client, attempts, every, pace, sleep, limit_s), "calls long, failed long").agg(F.sum("calls")).collect()
    recover(spark, ledger)
    found = materialise(replies(spark, ledger).select(F.col("digest").alias("__digest"), F.col("reply").alias(name), F.col("thinking").alias(f"{name}_thinking"), F.col("error").alias("__error")), "replies")
    error = F.when(F.col("__digest").isNull(), F.lit("no prompt")).otherwise(F.col("__error"))
    return keyed.join(found, "__digest", "left").withColumn(f"{name}_error", error).drop("__digest", "__error")
