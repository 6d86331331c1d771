"""Writers and export frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions import ellipsis, strip
from scoreloom.operators.questions import pair_by_index


def replace_models(df: DataFrame, path: str) -> None:
    """Write a folder for each model that ``df`` has; folders of other models stay. For one writer at a time; ``versions.replace_parts`` is for several, and
    shows readers whole versions only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_cases(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def case_summary(cases: DataFrame, text: str = "case_text", n: int = 500) -> DataFrame:
    return cases.withColumn(text, ellipsis(F.col(text), n))


def question_list(df: DataFrame, within: list[str], order: str) -> DataFrame:
    """Questions with their 1-based place in each case."""
    return df.withColumn("idx", F.row_number().over(W.partitionBy(*within).orderBy(order)))


def import_template(spark: SparkSession, cases: DataFrame | None = None) -> DataFrame:
    """Two example rows of the import sheet, and below them the given cases as rows of the sheet: those that an import would take."""
    rows = [("示例案例一", "案件事实。", "2024-01-01", "判决如下：支持。"), ("示例案例二", "案件事实。", "", "")]
    example = spark.createDataFrame(rows, "title string, case_text string, case_date string, judge_decision string")
    if cases is None:
        return example
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in cases.columns else F.lit("") for c in example.columns}
    sheet = cases.select(*[x.alias(c) for c, x in texts.items()])
    return example.unionByName(sheet.where((strip(F.col("title")) != "") & (strip(F.col("case_text")) != "")))


def split_sheets(book: DataFrame, sheet: str, path: str, without: tuple[str, ...] = ()) -> None:
    """One workbook of rows by ``sheet`` as a folder of CSV files with a header for each sheet; those in ``without`` are left out, and so are rows of
    no sheet. Rows go to files where they are, so a large sheet has several."""
    kept = book.where(F.col(sheet).isNotNull() & ~F.col(sheet).isin(*without)) if without else book.where(F.col(sheet).isNotNull())
    kept.write.mode("overwrite").option("header", "true").option("escape", '"').option("quoteAll", "true").partitionBy(sheet).csv(path)


SCORES = ("total", "d1", "d2", "d3", "d4", "d5")
ERRORS = ("n_minor", "n_moderate", "n_major")


def session_export(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each question of a session, from its arrays ``questions``, ``answers`` and ``evaluations`` (structs of scores and
    error counts) side by side; what has no partner in all three is left out, and scores that are missing count 0."""
    rows = pair_by_index(sessions, keys, "questions", "answers", "evaluations")
    scores = {c: F.coalesce(F.col(f"evaluations.{c}"), F.lit(0)) for c in (*SCORES, *ERRORS)}
    return rows.select(*keys, "idx", F.col("questions").alias("question"), F.col("answers").alias("answer"), *[c.alias(n) for n, c in scores.items()])


def session_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(metric, value) of each session's evaluations: questions, means to two places, and sums of errors."""
    by = by or []
    means = [F.round(F.avg(c), 2).alias(f"mean_{c}") for c in SCORES]
    one = df.groupBy(*by).agg(F.count("*").cast("double").alias("questions"), *means, *[F.sum(c).cast("double").alias(c) for c in ERRORS])
    return one.unpivot(by, [c for c in one.columns if c not in by], "metric", "value")


def cost_table(costs: DataFrame, path: str) -> None:
    """The cost table as one CSV file in the order of its costs: a row for each provider."""
    columns = ["provider", "tokens_in", "tokens_out", "tokens_total", "price_in", "price_out", "cost_in", "cost_out", "cost"]
    table = costs.withColumns({"tokens_total": F.col("tokens_in") + F.col("tokens_out"), "cost_in": F.round("cost_in", 2), "cost_out": F.round("cost_out", 2)})
    table.select(*columns).coalesce(1).sortWithinPartitions("cost", "provider").write.mode("overwrite").option("header", "true").csv(path)


def analysis_rows(results: DataFrame, now: Column) -> DataFrame:
    """The eight columns of the analysis export; what is missing is blank, and ``created_at`` is ``now``."""
    columns = ("case_id", "case_title", "case_text", "question", "ai_decision", "judge_decision", "comparison")
    held = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in results.columns else F.lit("").alias(c) for c in columns]
    made = F.coalesce(F.col("created_at").cast("string"), now) if "created_at" in results.columns else now
    return results.select(*held, made.alias("created_at"))


def case_list(cases: DataFrame, mask: Callable[[Column], Column] | None = None) -> DataFrame:
    """The case list with its masked columns, or without any; a decision that says 'nan' is blank."""
    decision = F.coalesce(F.nullif(F.col("judge_decision"), F.lit("nan")), F.lit(""))
    rows = cases.select("case_id", "title", "case_text", decision.alias("judge_decision"), "case_date", "created_at")
    if mask is None:
        return rows
    return rows.withColumns({f"{c}_masked": mask(F.col(c)) for c in ("case_text", "judge_decision")})


def latest_usage(calls: DataFrame, ts: str, key: str, n: int = 1000) -> DataFrame:
    """The last ``n`` calls, as the usage file keeps."""
    return calls.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)
