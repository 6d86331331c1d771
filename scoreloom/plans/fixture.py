"""Evaluation rows made from the given tables by integer arithmetic, in Spark and in SQL.

Each document is a question of a case, answered by seven models; the judge's text is put together from scores and
flags that follow from the document's length and the model's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.operators import rubric
from scoreloom.plans.registry import table

MODELS = 7
#: Score of each dimension: (factor of n, factor of the model's number, shift), modulo 5.
RAW = ((1, 3, 0), (2, 1, 1), (3, 1, 0), (1, 2, 2), (4, 1, 3))
MINOR_TEXT, MODERATE_TEXT, MAJOR_TEXTS = "表述略有瑕疵", "引用了已废止的旧法条文", ("回答中编造事实", "出现受害者责备")


def models(spark: SparkSession) -> DataFrame:
    return spark.range(MODELS).select(F.col("id").cast("int").alias("mi"), F.concat(F.lit("m"), "id").alias("model"))


def evaluations(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    """Answers are the documents' ``text``, or what else that says as SQL."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(text).alias("text"), F.col("n_chars").alias("n"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    grid = docs.join(labels, "doc_id", "left").crossJoin(F.broadcast(models(spark)))  # seven models
    n, mi = F.col("n"), F.col("mi")
    parts = []
    for name, (a, b, c) in zip(V.DIMENSIONS, RAW, strict=True):
        parts += [F.lit(f"【{name}】\n得分："), ((a * n + b * mi + c) % 5).cast("string"), F.lit("分\n理由：见上\n")]
    s = n + mi
    parts += [
        F.lit("【错误标记】（如有）：\n- 微小错误："), F.when(s % 3 == 0, MINOR_TEXT).otherwise("无"),
        F.lit("\n- 明显错误："), F.when(s % 5 == 0, MODERATE_TEXT).otherwise("无"),
        F.lit("\n- 重大错误："), F.when(s % 11 == 0, MAJOR_TEXTS[0]).when(s % 13 == 0, MAJOR_TEXTS[1]).otherwise("无"),
    ]
    return grid.select(
        "doc_id", "n", "mi", "model",
        F.floor(F.col("doc_id") / 5).cast("long").alias("case_id"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("q_no"),
        F.concat(F.lit("case "), F.floor(F.col("doc_id") / 5).cast("string")).alias("title"),
        F.when(F.col("toxic") == 1, F.lit(None)).when(s % 17 == 0, " ").otherwise(F.col("text")).alias("answer"),
        F.concat(*parts).alias("judge_text"),
        (1000 + n % 997 + 10 * mi).alias("tokens_in"), (500 + (n * 7 + mi) % 499).alias("tokens_out"),
    )


def scored(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    """Evaluation rows with their scores; error columns are joined texts, null where there is none."""
    rows = rubric.evaluate(evaluations(spark, sf_dir, text))
    counts = {f"n_{c}": F.size(c).cast("long") for c in ("minor", "moderate", "major")}
    return rubric.flatten_errors(rows.withColumns(counts)).withColumn("rationale", F.lit("见上"))


def _sql_scores() -> str:
    return " || ".join(f"'【{name}】' || chr(10) || '得分：' || CAST(({a} * d.n_chars + {b} * m.mi + {c}) % 5 AS VARCHAR) || '分' || chr(10) || '理由：见上' || chr(10)" for name, (a, b, c) in zip(V.DIMENSIONS, RAW, strict=True))


_S = "(d.n_chars + m.mi)"
#: Defines fx, the evaluation rows.
FX = f"""WITH models AS (SELECT CAST(range AS INTEGER) AS mi, 'm' || range AS model FROM range({MODELS})),
fx AS (
  SELECT d.doc_id, d.n_chars AS n, m.mi, m.model, d.doc_id // 5 AS case_id, CAST(d.doc_id % 5 + 1 AS INTEGER) AS q_no,
         'case ' || (d.doc_id // 5) AS title,
         CASE WHEN l.toxic = 1 THEN NULL WHEN {_S} % 17 = 0 THEN ' ' ELSE d.text END AS answer,
         {_sql_scores()}
         || '【错误标记】（如有）：' || chr(10) || '- 微小错误：' || CASE WHEN {_S} % 3 = 0 THEN '{MINOR_TEXT}' ELSE '无' END
         || chr(10) || '- 明显错误：' || CASE WHEN {_S} % 5 = 0 THEN '{MODERATE_TEXT}' ELSE '无' END
         || chr(10) || '- 重大错误：' || CASE WHEN {_S} % 11 = 0 THEN '{MAJOR_TEXTS[0]}' WHEN {_S} % 13 = 0 THEN '{MAJOR_TEXTS[1]}' ELSE '无' END AS judge_text,
         1000 + d.n_chars % 997 + 10 * m.mi AS tokens_in, 500 + (d.n_chars * 7 + m.mi) % 499 AS tokens_out
  FROM documents d CROSS JOIN models m LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def _raw(k: int) -> str:
    return f"CAST(regexp_extract(judge_text, '【{V.DIMENSIONS[k]}】.*?得分：\\s*(\\d+)', 1, 's') AS BIGINT)"


_NONE = "'无'"
#: Also defines raw (parsed scores and flag texts), capped, and sc (the score rows).
SC = f"""{FX}, raw AS (
  SELECT *, {", ".join(f"least(4, greatest(0, {_raw(k)})) AS r{k + 1}" for k in range(5))},
         nullif(regexp_extract(split_part(judge_text, '【错误标记】', 2), '{V.MINOR}：([^\\n]*)', 1), {_NONE}) AS minor,
         nullif(regexp_extract(split_part(judge_text, '【错误标记】', 2), '{V.MODERATE}：([^\\n]*)', 1), {_NONE}) AS moderate,
         nullif(regexp_extract(split_part(judge_text, '【错误标记】', 2), '{V.MAJOR}：([^\\n]*)', 1), {_NONE}) AS major
  FROM fx
), capped AS (
  SELECT *, r1 AS c1, CASE WHEN r1 = 0 THEN least(r2, 1) ELSE r2 END AS c2, r3 AS c3, r4 AS c4,
         CASE WHEN r4 <= 1 THEN least(CASE WHEN r1 = 0 THEN least(r5, 1) ELSE r5 END, 2) WHEN r1 = 0 THEN least(r5, 1) ELSE r5 END AS c5,
         CAST(minor IS NOT NULL AS BIGINT) AS n_minor, CAST(moderate IS NOT NULL AS BIGINT) AS n_moderate, CAST(major IS NOT NULL AS BIGINT) AS n_major
  FROM raw
), kept AS (
  SELECT *, 100 - least(80, 50 * n_major + 15 * n_moderate + 3 * n_minor) AS k,
         coalesce(contains(major, '受害者责备'), false) AS blame, coalesce(contains(major, '编造事实'), false) AS made_up
  FROM capped
), hundredths AS (
  SELECT *, CASE WHEN made_up THEN least(c1 * k, 100) ELSE c1 * k END AS e1, CASE WHEN made_up THEN least(c2 * k, 100) ELSE c2 * k END AS e2,
         CASE WHEN blame THEN least(c3 * k, 100) ELSE c3 * k END AS e3, CASE WHEN made_up THEN 0 ELSE c4 * k END AS e4,
         CASE WHEN blame THEN least(c5 * k, 100) ELSE c5 * k END AS e5
  FROM kept
), sc AS (
  SELECT *, CAST(e1 + e2 + e3 + e4 + e5 AS BIGINT) AS total_h, CAST(e1 + e2 + e3 + e4 + e5 AS DOUBLE) / 100 AS total,
         CAST(e1 AS DOUBLE) / 100 AS d1, CAST(e2 AS DOUBLE) / 100 AS d2, CAST(e3 AS DOUBLE) / 100 AS d3, CAST(e4 AS DOUBLE) / 100 AS d4, CAST(e5 AS DOUBLE) / 100 AS d5,
         CASE WHEN e1 + e2 + e3 + e4 + e5 >= 1600 THEN '{V.GRADES[0]}' WHEN e1 + e2 + e3 + e4 + e5 >= 1100 THEN '{V.GRADES[1]}'
              WHEN e1 + e2 + e3 + e4 + e5 >= 600 THEN '{V.GRADES[2]}' ELSE '{V.GRADES[3]}' END AS grade,
         nullif(concat_ws('; ', '{V.MINOR}: ' || minor, '{V.MODERATE}: ' || moderate, '{V.MAJOR}: ' || major), '') AS error_flag,
         '见上' AS rationale
  FROM hundredths
)"""
KEYS = ["model", "case_id", "q_no"]


#: Every document with one of all benchmark items, in turn.
PAIRS = "WITH nb AS (SELECT count(*) AS items FROM benchmark), p AS (SELECT d.doc_id, d.source, d.text AS a, b.text AS b FROM documents d CROSS JOIN nb JOIN benchmark b ON b.item_id = d.doc_id % nb.items)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("a"), (F.col("doc_id") % items.count()).alias("item_id"))
    return docs.join(items, "item_id").drop("item_id")
