"""A whole evaluation run: questions by models, answers, judgements, scores, and rows for what failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.operators import rubric
from scoreloom.operators.judging import CRITERIA, with_judge_prompt
from scoreloom.operators.questions import prompt
from scoreloom.sources.ledger import ask_once
from scoreloom.sources.models import ANALYSIS_PROMPT, Client

KEYS = ["model", "case_id", "q_no"]


def evaluate_run(
    grid: DataFrame,
    ledger: str,
    answerer: Callable[[str | None], Client],
    judge: Callable[[str | None], Client],
    keys: list[str] | None = None,
    template: str = ANALYSIS_PROMPT,
    criteria: dict[str, str] = CRITERIA,
    **calls,
) -> DataFrame:
    """The score rows of ``grid(model, case_id, q_no, question, case_text, decision)``, one for every row.

    Each model answers each question of its case, the judge replies to each answer, and the reply is scored. A row whose answer or
    judgement failed has total 0, the failure grade, null dimensions, and what went wrong in ``proc_error``; its answer then says
    so. Every call goes through the ledger, so a run that ended half-way, or is repeated, calls for what is missing only. Rows
    that repeat a key are answered once and stay; null texts are empty.
    """
    keys = keys or KEYS
    asked = grid.withColumn("__prompt", prompt(template, text=F.col("case_text"), question=F.col("question")))
    answered = ask_once(asked, "__prompt", ledger, answerer, kind="analyse", model="model", name="answer", **calls).drop("__prompt")
    wanted = with_judge_prompt(answered, "question", "answer", "decision", "case_text", "__prompt", criteria)
    wanted = wanted.withColumn("__prompt", F.when(F.col("answer").isNotNull(), F.col("__prompt")))
    judged = ask_once(wanted, "__prompt", ledger, judge, kind="judge", name="judge_text", **calls).drop("__prompt")
    scored = rubric.flatten_errors(rubric.evaluate(judged))
    failed = F.coalesce("answer_error", "judge_text_error")
    done = failed.isNull()
    scores = {c: F.when(done, F.col(c)).otherwise(F.lit(0.0)) for c in ("total", "pct")}
    only = {c: F.when(done, F.col(c)) for c in (*rubric.D, "minor", "moderate", "major", "error_flag")}
    return scored.withColumns(
        {**scores, **only, "grade": F.when(done, F.col("grade")).otherwise(V.FAILED_GRADE), "proc_error": failed, "answer": F.coalesce("answer", F.concat(F.lit("[错误："), "answer_error", F.lit("]"))), "failed": ~done}
    ).select(*keys, "question", "answer", "answer_thinking", *rubric.D, "total", "pct", "grade", "error_flag", "minor", "moderate", "major", F.col("judge_text").alias("rationale"), "judge_text_thinking", "proc_error", "failed")
