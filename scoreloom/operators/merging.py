"""Unions, replacements and lookups of evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions import strip, try_double


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds each missing column as nulls of its type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def union_coerced(old: DataFrame, new: DataFrame, strings: list[str], numbers: list[str]) -> DataFrame:
    """All rows of both with the columns of both; text columns are never null nor 'nan' or 'None', number columns
    hold null where there is no number."""
    both = old.unionByName(new, allowMissingColumns=True)
    text = {c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("nan", "None"), "").otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in strings if c in both.columns}
    return both.withColumns(text | {c: try_double(F.col(c).cast("string")) for c in numbers if c in both.columns})


def union_checks(old: DataFrame, new: DataFrame, both: DataFrame, answer: str = "answer") -> DataFrame:
    """One row: counts before and after, and whether rows and filled answers add up."""
    def sums(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"n_{name}"), F.count_if(F.coalesce(strip(F.col(answer)), F.lit("")) != "").alias(f"filled_{name}"))

    row = sums(old, "old").crossJoin(sums(new, "new")).crossJoin(sums(both, "all"))  # one row each
    return row.withColumns({"rows_ok": F.col("n_old") + F.col("n_new") == F.col("n_all"), "answers_ok": F.col("filled_all") >= F.col("filled_old") + F.col("filled_new")})


def replace_part(old: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """``old`` without the keys that ``new`` brings, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def select_cases(cases: DataFrame, ids: DataFrame | None = None, first: int | None = None, order: str = "case_id") -> DataFrame:
    """The named cases, else all or the first ones in store order."""
    if ids is not None:
        return cases.join(ids, "case_id", "left_semi")
    return cases if first is None else cases.orderBy(order).limit(first)


def missing_ids(cases: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(cases, "case_id", "left_anti")


def import_new(store: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Rows of the batch whose title the store doesn't have, the first one of each title."""
    first = batch.groupBy("title").agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
    return first.join(store, "title", "left_anti")


def prepared_or(cases: DataFrame, prepared: DataFrame, columns: list[str]) -> DataFrame:
    """Cases with what was prepared for them; ``ready`` tells if there was any."""
    return cases.join(prepared.select("case_id", *columns, F.lit(True).alias("ready")), "case_id", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))


def evaluation_grid(questions: DataFrame, models: DataFrame) -> DataFrame:
    """Every question for every model. Spark sends the smaller side around if its size is known to allow it."""
    return questions.crossJoin(models)


def model_deltas(stats: DataFrame, value: str) -> DataFrame:
    """Difference of each pair of models, one row each in ``stats``."""
    a = stats.select(F.col("model").alias("a"), F.col(value).alias("va"))
    b = stats.select(F.col("model").alias("b"), F.col(value).alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("va") - F.col("vb")).alias("delta"))


def reuse_questions(rows: DataFrame, preferred: str, n: int = 5) -> DataFrame:
    """The first ``n`` questions of each case that has as many, of the preferred model's rows if there are any."""
    has = rows.where(F.col("model") == preferred).limit(1).agg((F.count("*") > 0).alias("has"))
    chosen = rows.crossJoin(F.broadcast(has)).where(~F.col("has") | (F.col("model") == preferred)).drop("has")  # one row
    window = W.partitionBy("case_id")
    placed = chosen.withColumns({"rn": F.row_number().over(window.orderBy("q_no", "question")), "cnt": F.count("*").over(window)})
    return placed.where((F.col("rn") <= n) & (F.col("cnt") >= n)).select("case_id", "q_no", "question")


def first_usable(*columns: tuple[str, int]):
    """The first column, by priority, that is longer than its least length."""
    return F.coalesce(*[F.when(F.length(c) > least, F.col(c)) for c, least in columns])
