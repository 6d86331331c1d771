"""Parts that writers replace at once; totals of streams, exactly once; sessions over time."""

import random
import shutil
import threading
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scoreloom.sources import files, versions
from scoreloom.streaming import stores
from scoreloom.streaming.sessions import ROCKS_DB, STATE_STORE, session_log


def rows_of(spark, path, **options):
    return sorted((r["model"] or "", r["n"], r["who"]) for r in versions.read(spark, path, **options).collect())


def frame(spark, model, who, n=40):
    return spark.createDataFrame([(model, i, who) for i in range(n)], "model string, n int, who string")


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "table")
    failed = []

    def write(model, who):
        try:
            versions.replace_parts(frame(spark, model, who), path, "model")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    pairs = [(f"m{k % 3}", f"w{k}") for k in range(9)]
    threads = [threading.Thread(target=write, args=p) for p in pairs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and versions.manifest(path).version == 9
    by = defaultdict(set)
    for model, n, who in rows_of(spark, path):
        by[model].add(who)
    assert set(by) == {"m0", "m1", "m2"} and all(len(w) == 1 for w in by.values())  # whole, and never mixed
    assert len(rows_of(spark, path)) == 120 and all((m, next(iter(w))) in pairs for m, w in by.items())
    # every version holds whole parts
    for v in range(1, 10):
        found = defaultdict(list)
        for model, n, who in rows_of(spark, path, version=v):
            found[model, who].append(n)
        assert all(ns == list(range(40)) for ns in found.values()) and len({m for m, _ in found}) == len(found)


def test_a_part_replaced_in_between_is_a_conflict(spark, tmp_path):
    path = str(tmp_path / "table")
    versions.replace_parts(frame(spark, "a", "1"), path, "model")
    seen = versions.manifest(path).version
    versions.replace_parts(frame(spark, "b", "2"), path, "model")
    versions.replace_parts(frame(spark, "a", "3"), path, "model", seen=seen)  # b's change is no conflict for a
    with pytest.raises(versions.Conflict, match="a"):
        versions.replace_parts(frame(spark, "a", "4"), path, "model", seen=seen)
    assert {w for _, _, w in rows_of(spark, path)} == {"2", "3"}
    assert not files.create_once(spark, f"{path}/manifests/{1:012d}.json", b"x")


def test_parts_edges(spark, tmp_path):
    path = str(tmp_path / "table")
    assert versions.read(spark, path) is None and versions.manifest(path).version == 0
    odd = [(None, 1, "n"), ("", 2, "e"), ("a/b=c %", 3, "o"), ("é", 4, "u")]
    df = spark.createDataFrame(odd, "model string, n int, who string")
    versions.replace_parts(df, path, "model")
    assert sorted(rows_of(spark, path)) == sorted((m or "", n, w) for m, n, w in odd)
    versions.replace_parts(df.where("n = 1").withColumn("who", F.lit("new")), path, "model", empty=["é"])
    assert rows_of(spark, path) == sorted([("", 1, "new"), ("", 2, "e"), ("a/b=c %", 3, "o")])
    assert rows_of(spark, path, parts=[None]) == [("", 1, "new")] and rows_of(spark, path, parts=["nowhere"]) == []
    versions.replace_parts(df.limit(0), path, "model")
    assert len(rows_of(spark, path)) == 3
    with pytest.raises(ValueError, match="columns"):
        versions.replace_parts(df.drop("who"), path, "model")
    assert versions.clean(path, keep=1) >= 1 and len(rows_of(spark, path)) == 3 and len(files.names(f"{path}/manifests")) == 1


CALLS = "ts timestamp, kind string, t_in long, t_out long"


def calls_of(rng, n, day):
    return [(datetime(2024, 1, day) + timedelta(seconds=rng.randrange(86400)), rng.choice(("judge", "analyse", None)), rng.choice((None, rng.randrange(1000))), rng.randrange(1000)) for _ in range(n)]


def brute_usage(rows):
    out = defaultdict(lambda: [0, 0, 0, 0])
    for ts, kind, a, b in rows:
        x = out[ts.strftime("%Y-%m-%d"), kind]
        for k, v in enumerate((1, a or 0, b or 0, (a or 0) + (b or 0))):
            x[k] += v
    return sorted((day, kind or "", *x) for (day, kind), x in out.items())


def test_usage_of_a_stream_counts_once(spark, tmp_path):
    rng = random.Random(1)
    source, path = str(tmp_path / "in"), str(tmp_path / "usage")
    everything = []

    def put(rows):
        everything.extend(rows)
        spark.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(source)
        stores.usage_into(stream, path, "calls", "ts", "t_in", "t_out", "kind").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["day"], r["kind"] or "", r["calls"], r["tokens_in"], r["tokens_out"], r["tokens_total"]) for r in versions.read(spark, path).collect())

    put(calls_of(rng, 50, 3))
    put(calls_of(rng, 50, 4))
    assert run("cp") == brute_usage(everything)
    before = str(tmp_path / "cp-before")
    shutil.copytree(tmp_path / "cp", before)
    put(calls_of(rng, 30, 4) + calls_of(rng, 5, 1))  # more of a day, and a late one
    assert run("cp") == brute_usage(everything)
    assert run("cp") == brute_usage(everything)  # a restart without news
    # The driver was lost after the table's commit and before the stream's own: the batch is replayed.
    version = versions.manifest(path).version
    shutil.rmtree(tmp_path / "cp")
    shutil.copytree(before, tmp_path / "cp")
    assert run("cp") == brute_usage(everything) and versions.manifest(path).version == version
    put(calls_of(rng, 20, 3))
    assert run("cp") == brute_usage(everything)


def test_a_batch_lost_before_its_commit_leaves_no_trace(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "usage")
    add = stores.add_batch(path, "s", {"day": F.col("day")}, {"n": F.col("n")}, "day")
    batch = spark.createDataFrame([("a", 1), ("a", 2), (None, 5), ("b", None)], "day string, n int")
    add(batch, 0)
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            add(batch, 1)
    add(batch, 1)
    add(batch, 1)
    add(batch, 0)
    other = stores.add_batch(path, "other stream", {"day": F.col("day")}, {"n": F.col("n")}, "day")
    other(batch.limit(1), 0)
    other(batch.limit(0), 1)
    assert sorted((r["day"] or "", r["n"]) for r in versions.read(spark, path).collect()) == [("", 10), ("a", 7), ("b", 0)]


def test_sliding_counts_of_a_stream(spark, tmp_path):
    rng = random.Random(2)
    source, path = str(tmp_path / "in"), str(tmp_path / "windows")
    events = [(datetime(2024, 1, 1, 10) + timedelta(seconds=rng.randrange(4000)), rng.choice("ab")) for _ in range(80)]
    for k in range(0, 80, 30):
        spark.createDataFrame(events[k : k + 30], "ts timestamp, user string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("ts timestamp, user string").option("maxFilesPerTrigger", 1).parquet(source)
    stores.sliding_into(stream, path, "w", "ts", "user", "60 seconds", "20 seconds").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    wanted = defaultdict(int)
    for ts, user in events:
        first = ts.replace(microsecond=0, second=ts.second // 20 * 20)
        for back in range(3):
            wanted[first - timedelta(seconds=20 * back), user] += 1
    assert {(r["began"], r["user"]): r["n"] for r in versions.read(spark, path).collect()} == dict(wanted)


STEPS = ("upload", "mask", "questions", "evaluate")


def brute_sessions(events, idle, until):
    """The log by applying all events in the order of time."""
    out, by = [], defaultdict(list)
    for session, ts, name in events:
        by[session].append((ts, STEPS.index(name) if name in STEPS else 9, name))
    for session, own in by.items():
        state = None
        for ts, place, _ in sorted(own):
            if state and ts > state["last"] + idle:
                out.append((session, state["last"] + idle, *state["row"], True))
                state = None
            step, furthest, repeats, refused = state["row"] if state else (0, 0, 0, 0)
            k = place + 1
            if k > len(STEPS) or k > furthest + 1:
                refused += 1
            else:
                repeats += k <= furthest
                step, furthest = k, 1 if k == 1 else max(k, furthest)
            state = {"row": (step, furthest, repeats, refused), "last": ts}
            out.append((session, ts, *state["row"], False))
        if until > state["last"] + idle + timedelta(seconds=1):
            out.append((session, state["last"] + idle, *state["row"], True))
    return sorted(out)


def test_sessions_over_time(spark, tmp_path):
    rng = random.Random(3)
    began = datetime(2024, 1, 1, 10)
    events = []
    for s in range(12):
        at = began + timedelta(seconds=rng.randrange(60))
        for name in [*STEPS, "mask", "upload", "nothing", *STEPS][: rng.randrange(1, 12)]:
            if rng.random() < 0.8:
                events.append((f"s{s}", at, name))
            if rng.random() < 0.2:
                events.append((f"s{s}", at, name))
            at += timedelta(seconds=rng.choice((0.5, 3, 20, 200)))
    events += [("whole", began + timedelta(seconds=k), name) for k, name in enumerate(STEPS)]
    # Arrival is out of order by up to 25 s, less than the watermark allows.
    arrival = sorted(events, key=lambda e: e[1] + timedelta(seconds=rng.random() * 25))
    end = max(e[1] for e in events) + timedelta(hours=1)
    source = str(tmp_path / "in")
    before = spark.conf.get(STATE_STORE, None)
    with pytest.raises(ValueError, match="RocksDB"):
        session_log(spark.readStream.schema("s string, ts timestamp, step string").parquet(str(tmp_path)), "s", "ts", "step", STEPS, 60)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:

        def run(rows):
            spark.createDataFrame(rows, "s string, ts timestamp, step string").coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema("s string, ts timestamp, step string").option("maxFilesPerTrigger", 1).parquet(source)
            log = session_log(stream, "s", "ts", "step", STEPS, 60, late="30 seconds")
            log.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

        third = len(arrival) // 3
        for part in (arrival[:third], arrival[third : 2 * third], arrival[2 * third :], [("z", end, "upload")], [("z", end + timedelta(hours=2), "upload")]):
            run(part)  # each time a new query takes up the checkpoint
        got = spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
    found = sorted((r["session"], r["at"], r["step"], r["furthest"], r["repeats"], r["refused"], r["expired"]) for r in got if r["session"] != "z")
    assert found == brute_sessions(events, timedelta(seconds=60), end)
    assert any(r["finished"] for r in got) and any(r["expired"] for r in got)
