"""Queries of whole evaluation runs: calls through the ledger, quotas, guarded replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.operators import judging
from scoreloom.plans.fixture import FX, MAJOR_TEXTS, MINOR_TEXT, MODERATE_TEXT, PAIRS, SC
from scoreloom.plans.registry import query, table
from scoreloom.scratch import new_path
from scoreloom.sources import versions
from scoreloom.sources.models import ANALYSIS_PROMPT, DigestClient, client_for
from scoreloom.sources.quota import ask_within
from scoreloom.sources.runs import evaluate_run
from scoreloom.streaming.stores import add_batch


def _text(s: str) -> str:
    """A text as SQL, with line ends as such."""
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_prompt(template: str, **places: str) -> str:
    """The template as SQL, each place filled."""
    for name, sql in places.items():
        template = template.replace("{" + name + "}", f"\x00{sql}\x00")
    return " || ".join(part if k % 2 else _text(part) for k, part in enumerate(template.split("\x00")) if part)


_FIXED = {"criteria": _text(judging.criteria_text(judging.CRITERIA)), "form": _text(judging.REPLY_FORM)}
_WITH = _sql_prompt(judging.WITH_DECISION, question="question", answer="answer", decision="decision", case="(CASE WHEN case_text = '' THEN '' ELSE '案例内容：' || chr(10) || left(case_text, 2000) || chr(10) || chr(10) END)", **_FIXED)
_WITHOUT = _sql_prompt(judging.WITHOUT_DECISION, question="question", answer="answer", case="(CASE WHEN case_text = '' THEN '无' ELSE left(case_text, 3000) END)", **_FIXED)
_GRID = PAIRS.replace("p AS (SELECT d.doc_id, d.source, d.text AS a, b.text AS b", "p AS (SELECT d.doc_id, d.source, d.n_chars, d.text AS a, b.text AS b") + """,
grid AS (SELECT doc_id, n_chars AS n, 'm' || doc_id % 7 AS model, doc_id // 5 AS case_id, CAST(doc_id % 5 + 1 AS INTEGER) AS q_no, coalesce(source, '') AS question, coalesce(a, '') AS case_text, CASE WHEN doc_id % 2 = 0 THEN b ELSE '' END AS decision FROM p)"""


def _maker(provider: str):
    return lambda model: client_for(provider, model)()


def grid(spark, d):
    """A question about every document, put to one of seven models; every other document has a decision: one of all benchmark
    items, in turn."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("b"))
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").alias("n"), "text", (F.col("doc_id") % items.count()).alias("item_id"))
    return docs.join(items, "item_id").select(
        "doc_id", "n", F.concat(F.lit("m"), (F.col("doc_id") % 7).cast("string")).alias("model"),
        F.floor(F.col("doc_id") / 5).cast("long").alias("case_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("q_no"),
        F.coalesce("source", F.lit("")).alias("question"), F.coalesce("text", F.lit("")).alias("case_text"),
        F.when(F.col("doc_id") % 2 == 0, F.col("b")).otherwise("").alias("decision"),
    )


@query(f"{_GRID}, g AS (SELECT doc_id, question, case_text AS answer, case_text, decision FROM grid) SELECT doc_id, CASE WHEN trim(decision) <> '' THEN {_WITH} ELSE {_WITHOUT} END AS prompt FROM g")
def q07_judge_prompt(spark, d):
    return grid(spark, d).select("doc_id", judging.judge_prompt(F.col("question"), F.col("case_text"), F.col("decision"), F.col("case_text")).alias("prompt"))


def _digit(k: int) -> str:
    return f"(strpos('0123456789abcdef', substr(h, {k + 1}, 1)) - 1)"


_JUDGED = _GRID + f""",
asked AS (SELECT *, {_sql_prompt(ANALYSIS_PROMPT, question="question", text="case_text")} AS prompt FROM grid),
answered AS (SELECT * EXCLUDE (prompt), CASE WHEN left(md5(prompt), 1) <> '0' THEN '回答' || md5(prompt) END AS answer FROM asked),
judged AS (SELECT *, md5(CASE WHEN trim(decision) <> '' THEN {_WITH} ELSE {_WITHOUT} END) AS h FROM answered),
fx AS (
  SELECT doc_id, n, 0 AS mi, model, case_id, q_no, question, answer, '' AS title,
         {" || ".join(_text(f"【{name}】" + chr(10) + "得分：") + f" || CAST({_digit(k)} % 5 AS VARCHAR) || " + _text("分" + chr(10) + "理由：见上" + chr(10)) for k, name in enumerate(V.DIMENSIONS))}
         || '【错误标记】（如有）：' || chr(10) || '- 微小错误：' || CASE WHEN {_digit(5)} % 3 = 0 THEN '{MINOR_TEXT}' ELSE '无' END
         || chr(10) || '- 明显错误：' || CASE WHEN {_digit(6)} % 5 = 0 THEN '{MODERATE_TEXT}' ELSE '无' END
         || chr(10) || '- 重大错误：' || CASE WHEN {_digit(7)} = 0 THEN '{MAJOR_TEXTS[0]}' WHEN {_digit(7)} = 1 THEN '{MAJOR_TEXTS[1]}' ELSE '无' END AS judge_text
  FROM judged
)"""


@query(SC.replace(FX, _JUDGED) + f"""
SELECT model, case_id, q_no, coalesce(answer, '[错误：empty reply]') AS answer, CASE WHEN answer IS NULL THEN 0 ELSE total END AS total,
       CASE WHEN answer IS NULL THEN '{V.FAILED_GRADE}' ELSE grade END AS grade, CASE WHEN answer IS NOT NULL THEN d1 END AS d1, CASE WHEN answer IS NOT NULL THEN d5 END AS d5,
       CASE WHEN answer IS NOT NULL THEN error_flag END AS error_flag, CASE WHEN answer IS NULL THEN 'empty reply' END AS proc_error, answer IS NULL AS failed
FROM sc""")
def e15_judged_run(spark, d):
    # The stand-ins answer at once: no pauses, and a journal of many calls a file.
    run = evaluate_run(grid(spark, d), new_path(spark, "ledger"), _maker("digest"), _maker("digest-judge"), every=4096, sleep=lambda s: None, limit_s=None)
    return run.select("model", "case_id", "q_no", "answer", "total", "grade", "d1", "d5", "error_flag", "proc_error", "failed")


@query("SELECT doc_id, '回答' || md5('问：' || coalesce(text, '')) AS reply FROM documents")
def x02_shared_quota(spark, d):
    """All tasks within one quota, which is wide here."""
    asked = table(spark, d, "documents").select("doc_id", F.concat(F.lit("问："), F.coalesce("text", F.lit(""))).alias("prompt"))
    return ask_within(asked, "prompt", lambda model: DigestClient(blanks=False), per_minute=60_000_000, limit_s=None).select("doc_id", "reply")


@query("SELECT coalesce(source, 'none') AS source, count(*) AS n, CAST(sum(n_chars + CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS chars FROM documents GROUP BY 1")
def k02_replaced_parts(spark, d):
    """Documents by language: one writer replaces a language, and one that has seen the older version may not."""
    path = new_path(spark, "parts")
    docs = table(spark, d, "documents").select("doc_id", "lang", F.coalesce("source", F.lit("none")).alias("source"), "n_chars")
    first = versions.replace_parts(docs, path, "lang")
    english = docs.where("lang = 'en'")
    versions.replace_parts(english.withColumn("n_chars", F.col("n_chars") + 1), path, "lang")
    try:
        versions.replace_parts(english.withColumn("n_chars", F.col("n_chars") * 0), path, "lang", seen=first.version)
    except versions.Conflict:
        pass
    return versions.read(spark, path).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def y02_stored_totals(spark, d):
    """Events come in three batches, one of them twice."""
    path = new_path(spark, "usage")
    events = table(spark, d, "events")
    add = add_batch(path, "events", {"day": F.date_format("ts", "yyyy-MM-dd"), "kind": F.col("event_type")}, {"calls": F.lit(1), "total": F.col("event_id")}, "day")
    for number, part in ((0, 0), (1, 1), (1, 1), (2, 2)):
        add(events.where(F.col("event_id") % 3 == part), number)
    return versions.read(spark, path)
