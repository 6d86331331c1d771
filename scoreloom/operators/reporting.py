"""What reports and charts show, as long frames: one row a value. All start from model statistics, a row for each model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.stats import D

ERRORS = ("major", "moderate", "minor")


def _long(rows: DataFrame, group: str, values: dict[str, Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), c.cast("double").alias("value")) for k, c in values.items()])
    return rows.select(F.lit(group).alias("section"), "model", F.inline(cells))


def report_tables(stats: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(section, model, metric, value)`` of the detailed report: scores, dimensions, answers, errors, stale law, tokens and
    efficiency. A model without token data has null there."""
    rows = stats.join(tokens, "model", "left")
    share = lambda c: F.col(c) * 100.0 / F.col("n")
    sections = {
        "scores": {"questions": F.col("n"), "mean": F.col("mean_score"), "percent": F.col("mean_score") * 5, "p10": F.col("p10"), "cvar10": F.col("cvar10")},
        "dimensions": {d: F.col(f"{d}_mean") for d in D},
        "answers": {"mean_length": F.col("mean_length"), "empty": F.col("refusal_count"), "empty_percent": share("refusal_count")},
        "errors": {**{e: F.col(f"{e}_count") for e in ERRORS}, "errors_percent": (F.col("major_count") + F.col("moderate_count") + F.col("minor_count")) * 100.0 / F.col("n")},
        "stale_law": {"questions": F.col("stale_count"), "percent": share("stale_count")},
        "tokens": {"in": F.col("avg_in"), "out": F.col("avg_out"), "total": F.col("avg_total"), "efficiency": F.try_divide(F.col("mean_score"), F.col("avg_total")) * 1000},
    }
    return reduce(DataFrame.unionByName, [_long(rows, name, values) for name, values in sections.items()])


def chart_frames(stats: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(section, model, metric, value)`` of the charts that show a value for each model, by the chart's name."""
    rows = stats.join(tokens, "model", "left")
    frames = {
        "pareto": {"mean": F.col("mean_score"), "stale_rate": F.col("stale_rate"), "tokens": F.col("avg_total")},
        "tail_risk": {"mean": F.col("mean_score"), "p10": F.col("p10"), "cvar10": F.col("cvar10")},
        "gating": {"stale_rate": F.col("stale_rate"), "passes": (F.col("stale_rate") <= 0.01).cast("int")},
        "mean_score": {"mean": F.col("mean_score")},
        "stale_law": {"count": F.col("stale_count")},
        "dimension_heatmap": {d: F.col(f"{d}_mean") for d in D},
        "metric_heatmap": {"score": F.col("mean_score") / 5, **{d: F.col(f"{d}_mean") for d in D}, **{c: F.col(f"{c}_count") / F.col("n") * 4 for c in (*ERRORS, "stale")}},
        "percentage": {"percent": F.col("mean_score") * 5},
        "errors": {e: F.col(f"{e}_count") for e in ERRORS},
    }
    with_tokens = rows.where("avg_total is not null")
    long = [_long(rows, name, values) for name, values in frames.items()]
    long.append(_long(with_tokens, "efficiency", {"mean": F.col("mean_score"), "tokens": F.col("avg_total")}))
    long.append(_long(with_tokens, "token_usage", {"in": F.col("avg_in"), "out": F.col("avg_out"), "total": F.col("avg_total")}))
    return reduce(DataFrame.unionByName, long)
