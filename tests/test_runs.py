"""Evaluation runs: the call ledger, the judging prompt, and the chain from questions to scores."""

import itertools
import json
import os
import time
import uuid
from collections import Counter

import pandas as pd
import pytest

from scoreloom.functions import fixed_values as V
from scoreloom.operators import judging
from scoreloom.sources import files, ledger
from scoreloom.sources.models import DigestClient, DigestJudge, Pace, exchange, pace_of
from scoreloom.sources.runs import evaluate_run


class Noting:
    """Notes each call as a file; fails, or ends its process, on prompts that say so."""

    def __init__(self, folder, fatal=()):
        self.folder, self.fatal = folder, fatal

    def complete(self, prompt, temperature, max_tokens):
        if prompt in self.fatal:
            os._exit(1)
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as out:
            out.write(prompt)
        if prompt.startswith("broken"):
            raise RuntimeError("no luck")
        return {"content": f"reply to {prompt}", "thinking": "hm", "finish_reason": "stop"}


def noted(folder):
    return Counter(p.read_text() for p in folder.iterdir())


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


QUICK = {"sleep": lambda s: None, "limit_s": None}


def test_ledger_asks_each_prompt_once(spark, tmp_path, calls):
    path, folder = str(tmp_path / "ledger"), str(calls)
    rows = [(i, f"prompt {i % 40}", "x") for i in range(200)] + [(900, None, "x"), (901, "", "x"), (902, "broken", "x")]
    df = spark.createDataFrame(rows, "id long, p string, digest string")

    def ask(frame):
        return ledger.ask_once(frame, "p", path, lambda model: Noting(folder), attempts=2, **QUICK)

    for action in (ask(df), ask(df)):
        got = {r["id"]: r for r in action.collect()}
        assert action.count() == len(rows) == len(got)  # a second action
        assert all(got[i]["reply"] == f"reply to prompt {i % 40}" and got[i]["reply_thinking"] == "hm" and got[i]["reply_error"] is None for i in range(200))
        assert got[900]["reply_error"] == got[901]["reply_error"] == "no prompt" and got[902]["reply"] is None and got[902]["reply_error"] == "no luck"
    found = noted(calls)
    assert all(found[f"prompt {k}"] == 1 for k in range(40)) and found["broken"] == 4  # two attempts in each of two runs
    ask(spark.createDataFrame([(1, "prompt 3", "x"), (2, "new", "x")], df.schema)).collect()
    assert noted(calls)["prompt 3"] == 1 and noted(calls)["new"] == 1
    assert ask(df.limit(0)).count() == 0


def test_kinds_and_models_are_told_apart(spark, tmp_path, calls):
    df = spark.createDataFrame([("a", "p"), ("b", "p"), (None, "p")], "m string, p string")
    for kind in ("analyse", "judge", "judge"):
        ledger.ask_once(df, "p", str(tmp_path / "ledger"), lambda model: Noting(str(calls)), kind=kind, model="m", **QUICK)
    assert noted(calls)["p"] == 6


def test_a_run_that_died_is_taken_up_where_it_was(spark, tmp_path, calls):
    """The process of a task ends in the middle of its calls, and the job with it."""
    path, folder = str(tmp_path / "ledger"), str(calls)
    df = spark.range(60).selectExpr("id", "concat('prompt ', id) AS p")
    with pytest.raises(Exception, match="."):
        ledger.ask_once(df, "p", path, lambda model: Noting(folder, {"prompt 7", "prompt 31"}), tasks=4, **QUICK)
    before = noted(calls)
    assert before and "prompt 7" not in before
    got = ledger.ask_once(df, "p", path, lambda model: Noting(folder), tasks=4, **QUICK)
    assert got.where("reply is not null").count() == 60
    assert set(noted(calls).values()) == {1} and len(noted(calls)) == 60


def test_an_attempt_of_a_task_goes_on_behind_the_last(tmp_path, calls, monkeypatch):
    attempt = itertools.count()
    task = type("Task", (), {"partitionId": lambda self: 3, "taskAttemptId": lambda self: next(attempt)})
    monkeypatch.setattr(ledger.TaskContext, "get", classmethod(lambda cls: task()))
    journal, seen = f"{tmp_path}/journal/run", []

    class Client:
        def complete(self, prompt, temperature, max_tokens):
            if len(seen) == 5 and "retried" not in seen:
                seen.append("retried")
                raise KeyboardInterrupt  # the executor is lost
            seen.append(prompt)
            return {"content": prompt, "finish_reason": "stop"}

    frame = pd.DataFrame({"digest": [f"d{k}" for k in range(12)], "kind": "analyse", "model": None, "prompt": [f"p{k}" for k in range(12)]})
    run = ledger._ask(journal, lambda model: Client(), 3, 1, lambda: Pace(10**6, 0), lambda s: None, None)
    with pytest.raises(KeyboardInterrupt):
        list(run(iter([frame])))
    (out,) = list(run(iter([frame])))
    assert out["calls"][0] == 7 and Counter(seen) == Counter([f"p{k}" for k in range(12)] + ["retried"])
    written = [json.loads(line)["digest"] for text in files.read_files(f"{journal}/00003").values() for line in text.splitlines()]
    assert sorted(written) == sorted(frame["digest"])


def test_recovery_adds_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "ledger")
    line = json.dumps({"digest": "d", "kind": "analyse", "model": None, "reply": "r", "thinking": None, "error": None, "attempts": 1, "at": 5}) + "\n"
    for run in ("one", "two"):
        files.write_file(f"{path}/journal/{run}/00000/0-0.json", line.encode())
    files.write_file(f"{path}/journal/empty/_hidden", b"")
    assert ledger.recover(spark, path) == 3 and ledger.entries(spark, path).count() == 1
    assert ledger.recover(spark, path) == 0 and ledger.replies(spark, path).first()["reply"] == "r"


def test_late_replies_are_tried_again():
    class Slow:
        n = 0

        def complete(self, prompt, temperature, max_tokens):
            self.n += 1
            if self.n < 3:
                time.sleep(5)
            return {"content": "at last", "finish_reason": "stop"}

    began = time.monotonic()
    found = exchange(Slow(), "p", 0.3, Pace(10**6, 0), sleep=lambda s: None, limit_s=0.2)
    assert found == {"reply": "at last", "thinking": None, "error": None, "attempts": 3} and time.monotonic() - began < 3
    assert exchange(type("Dead", (), {"complete": lambda *a: time.sleep(5)})(), "p", 0.3, Pace(10**6, 0), attempts=1, sleep=lambda s: None, limit_s=0.1)["error"] == "no reply in 0.1 s"


def test_judge_prompt_places(spark):
    long = "x" * 5000
    rows = [("q {answer}", "a {decision}", "d {criteria}", "case"), ("q", "a", " 　\n", long), ("q", "a", None, ""), ("q", "a", "d", None), (None, None, "d", long)]
    df = judging.with_judge_prompt(spark.createDataFrame(rows, "q string, a string, d string, c string"), "q", "a", "d", "c")
    texts = [r["judge_prompt"] for r in df.collect()]
    assert all(d in t for d in V.DIMENSIONS for t in texts) and "问题：\nq {answer}\n\n回答：\na {decision}\n\n法官判决：\nd {criteria}\n\n案例内容：\ncase\n" in texts[0]
    assert "x" * 3000 in texts[1] and "x" * 3001 not in texts[1] and "没有参照判决" in texts[1]
    assert "案例内容：\n无\n" in texts[2] and "案例内容" not in texts[3] and "法官判决：\nd" in texts[3]
    assert "x" * 2000 in texts[4] and "x" * 2001 not in texts[4] and "{" not in texts[4]


def test_run_scores_what_succeeds_and_reports_what_fails(spark, tmp_path):
    from scoreloom.operators import rubric

    rows = [(f"m{i % 3}", i // 5, i % 5 + 1, f"question {i}", f"case {i}", None if i % 2 else f"decision {i}") for i in range(120)] + [("m0", 0, 1, "question 0", "case 0", "decision 0")]
    grid = spark.createDataFrame(rows, "model string, case_id long, q_no int, question string, case_text string, decision string")
    run = evaluate_run(grid, str(tmp_path / "ledger"), lambda model: DigestClient(), lambda model: DigestJudge(), every=50, **QUICK)
    got = run.collect()
    assert len(got) == len(rows)
    bad = [r for r in got if r["failed"]]
    assert 0 < len(bad) < 40 and all(r["total"] == 0 and r["grade"] == V.FAILED_GRADE and r["d1"] is None and r["proc_error"] == "empty reply" and r["answer"] == "[错误：empty reply]" for r in bad)
    good = [r for r in got if not r["failed"]]
    again = {r["t"]: r for r in rubric.evaluate(spark.createDataFrame([(r["rationale"],) for r in good], "t string"), "t").collect()}
    assert all(r["total"] == again[r["rationale"]]["total"] and r["grade"] == again[r["rationale"]]["grade"] for r in good)
    n = ledger.entries(spark, str(tmp_path / "ledger")).where("error is null").count()
    evaluate_run(grid, str(tmp_path / "ledger"), lambda model: DigestClient(), lambda model: DigestJudge(), every=50, **QUICK)
    assert ledger.entries(spark, str(tmp_path / "ledger")).where("error is null").count() == n


def test_stand_ins_wait_for_no_quota(spark, tmp_path):
    """More calls of one task than the usual pace has in a minute."""
    df = spark.range(0, 3100, 1, 1).selectExpr("id", "concat('prompt ', id) AS p")
    began = time.monotonic()
    got = ledger.ask_once(df, "p", str(tmp_path / "ledger"), lambda model: DigestClient(blanks=False), tasks=1, every=4096, **QUICK)
    assert got.where("reply is not null").count() == 3100 and time.monotonic() - began < 40


def test_pace_holds_only_who_has_a_quota():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    for per_minute, waits in ((3, [60.0, 60.0]), (None, [])):
        slept.clear()
        pace = Pace(per_minute, 0.0, lambda: now[0], sleep)
        for _ in range(9):
            pace.wait()
        assert slept == waits and len(pace.calls) <= (per_minute or 1)
        now[0] += 1000
    assert pace_of(DigestJudge()).per_minute is None and pace_of(Noting("")).per_minute == 3000
