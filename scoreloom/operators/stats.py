"""Statistics over evaluation rows: means, quantiles, tails, flags, matrices, bootstrap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import contains_any, null_if_blank, strip
from scoreloom.functions import fixed_values as V
from scoreloom.operators.quantiles import exact_quantiles, skyline
from scoreloom.scratch import materialise

D = ("d1", "d2", "d3", "d4", "d5")


def is_refusal(answer: Column) -> Column:
    return answer.isNull() | (strip(answer) == "")


def is_valid_answer(answer: Column) -> Column:
    return ~is_refusal(answer) & (F.lower(answer) != "nan")


def mentions_stale_law(variant: int = 1) -> Column:
    """Variant 1: the first word list over rationale, the three severities and the summary, joined. Variant 2: the
    second list, lower-cased, over the same columns but for the summary."""
    texts = ["rationale", "major", "moderate", "minor"]
    if variant == 1:
        return contains_any(F.concat_ws(" ", *texts, "error_flag"), V.STALE_LAW_V1)
    return contains_any(F.lower(F.concat_ws(" ", *texts)), V.STALE_LAW_V2)


def model_stats(df: DataFrame, by: str = "model", score: str = "total") -> DataFrame:
    """One row a model: n of all rows; mean, p10 and CVaR of the scores there are; stale, error and refusal counts
    with rates; mean answer length; dimension means. Texts are read once, for a narrow table that all else comes from; quantile
    and tail are exact for any number of scores. A null model is one of its own, without p10 and CVaR."""
    refused = is_refusal(F.col("answer"))
    narrow = df.select(
        by, F.col(score).alias("score"), mentions_stale_law(1).alias("stale"), refused.alias("refused"), F.when(~refused, F.length(strip(F.col("answer")))).alias("length"),
        *[null_if_blank(F.col(c)).isNotNull().alias(c) for c in ("major", "moderate", "minor")], *D,
    )
    narrow = materialise(narrow, "narrow")
    main = narrow.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean_score"),
        F.count_if("stale").alias("stale_count"),
        *[F.count_if(c).alias(f"{c}_count") for c in ("major", "moderate", "minor")],
        F.count_if("refused").alias("refusal_count"),
        F.avg("length").alias("mean_length"),
        *[F.avg(d).alias(f"{d}_mean") for d in D],
    )
    tails = exact_quantiles(narrow, [by], F.col("score"), [0.1], written=True).select(by, F.col("value").alias("p10"), F.col("tail_mean").alias("cvar10"))
    joined = main.join(tails, by, "left")
    return joined.withColumns({"stale_rate": F.col("stale_count") / F.col("n"), "refusal_rate": F.col("refusal_count") / F.col("n")})


def cvar(df: DataFrame, quantiles: DataFrame, by: str = "model", score: str = "total", q: str = "p10") -> DataFrame:
    """Mean of the scores at or below each group's quantile."""
    return df.join(quantiles, by).where(F.col(score) <= F.col(q)).groupBy(by).agg(F.avg(score).alias("cvar10"))


def score_summary(df: DataFrame, by: list[str], score: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.max(score).alias("max"), F.min(score).alias("min"), F.median(score).alias("median"), F.stddev_samp(score).alias("std"))


def dimension_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """d1..d5 as rows (dim, score)."""
    return df.unpivot(keys, list(D), "dim", "score")


def bands(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows at 16 and more, 11 and more, 6 and more, below, with shares of all rows."""
    t = F.col("total")
    edges = {"high": t >= 16, "good": (t >= 11) & (t < 16), "fair": (t >= 6) & (t < 11), "low": t < 6}
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in edges.items()])
    return out.withColumns({f"{k}_pct": F.col(k) * 100.0 / F.col("n") for k in edges})


def shares(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Counts of a column's values with percent of their group."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("all_n")) if by else counts.agg(F.sum("n").alias("all_n"))
    joined = counts.join(total, by) if by else counts.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("pct", F.col("n") * 100.0 / F.col("all_n")).drop("all_n")


def histogram(df: DataFrame, score: str, bins: int) -> DataFrame:
    """Equal bins from least to greatest value; the last is closed. Values alike fall in the first bin."""
    edge = df.agg(F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col(score) - F.col("lo")) / width) + 1, F.lit(bins)))
    return df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row


def trends(df: DataFrame) -> DataFrame:
    """Straight line of each ordered pair of dimensions."""
    pairs = [(x, y) for x in D for y in D if x != y]
    lines = df.agg(*[f for x, y in pairs for f in (F.regr_slope(y, x).alias(f"{x}{y}s"), F.regr_intercept(y, x).alias(f"{x}{y}i"))])
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{x}{y}s").alias("slope"), F.col(f"{x}{y}i").alias("intercept")) for x, y in pairs])
    return lines.select(F.inline(rows))


def _weights(seed: int, group: str, value: float, n: int, resamples: int) -> np.ndarray:
    """How often ``n`` rows of a value are drawn in each resample: independent Poisson counts, the same for a group and value wherever they are drawn."""
    key = int.from_bytes(hashlib.blake2b(f"{seed}|{group}|{value!r}".encode(), digest_size=16).digest(), "little")
    return np.random.Generator(np.random.Philox(key=key)).poisson(n, resamples)


def bootstrap_means(df: DataFrame, resamples: int = 4000, by: str = "model", score: str = "total", seed: int = 42) -> DataFrame:
    """Percentile interval of each group's mean under resampling with replacement, for groups of any size. Every row counts in a resample as
    often as a Poisson draw of mean 1 says, so the rows of a score by one of mean their number. Tasks draw for the scores that they
    have and add up one array of sums and one of counts a group; Spark adds these arrays up, place by place. The same seed
    gives the same interval, however the rows are dealt. Null scores are left out."""
    counted = df.where(F.col(score).isNotNull()).groupBy(F.col(by).cast("string").alias("g"), F.col(score).cast("double").alias("x")).agg(F.count("*").alias("n"))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for f in frames:
            for g, x, n in zip(f["g"], f["x"], f["n"], strict=True):
                if g not in totals:
                    totals[g] = np.zeros(resamples), np.zeros(resamples, np.int64)
                drawn = _weights(seed, str(g), x, n, resamples)
                totals[g][0][:] += drawn * x
                totals[g][1][:] += drawn
                if len(totals) > 64:
                    yield from map(rows, totals.items())
                    totals = {}
        yield from map(rows, totals.items())

    def rows(item: tuple) -> pd.DataFrame:
        return pd.DataFrame({"g": item[0], "i": np.arange(resamples, dtype=np.int32), "s": item[1][0], "w": item[1][1]})

    sums = counted.mapInPandas(partial, "g string, i int, s double, w long").groupBy("g", "i").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    mean = F.round(F.try_divide("s", "w"), 9)  # sums of the same numbers in another order
    bounds = sums.groupBy("g").agg(F.percentile(mean, F.array(F.lit(0.025), F.lit(0.975))).alias("b"))  # of so many resamples
    centre = counted.groupBy("g").agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 9).alias("mean"))
    joined = bounds.join(centre.withColumnRenamed("g", "g_"), F.col("g").eqNullSafe(F.col("g_")))
    return joined.select(F.col("g").alias(by), F.col("b")[0].alias("low"), "mean", F.col("b")[1].alias("high"))


def bootstrap_exact(df: DataFrame, resamples: int = 5000, seed: int = 42, by: str = "model", score: str = "total") -> DataFrame:
    """The classic interval with numpy's stream, for groups of reporting size: one task gathers a group."""

    def interval(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[score].dropna().to_numpy()
        if not len(x):
            return pd.DataFrame({by: frame[by].iloc[:1], "low": [None], "mean": [None], "high": [None]})
        rng = np.random.default_rng(seed)
        means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(resamples)])
        return pd.DataFrame({by: frame[by].iloc[:1].to_numpy(), "low": [np.quantile(means, 0.025)], "mean": [x.mean()], "high": [np.quantile(means, 0.975)]})

    return df.select(by, score).groupBy(by).applyInPandas(interval, f"{by} string, low double, mean double, high double")


def error_cohorts(df: DataFrame) -> DataFrame:
    return df.groupBy(null_if_blank(F.col("error_flag")).isNotNull().alias("has_error")).agg(F.count("*").alias("n"), F.avg("total").alias("mean"), F.median("total").alias("median"), F.max("total").alias("max"))


def metric_matrix(stats: DataFrame) -> DataFrame:
    """Model statistics on a common scale of 0 to 4, as (model, metric, value)."""
    scaled = stats.select(
        "model", (F.col("mean_score") / 5).alias("score"), *[F.col(f"{d}_mean").alias(d) for d in D],
        *[(F.col(f"{c}_count") / F.col("n") * 4).alias(c) for c in ("major", "moderate", "minor", "stale")],
    )
    return scaled.unpivot(["model"], [c for c in scaled.columns if c != "model"], "metric", "value")


def answer_lengths(df: DataFrame, by: list[str]) -> DataFrame:
    n = F.when(is_valid_answer(F.col("answer")), F.length("answer"))
    return df.groupBy(*by).agg(F.avg(n).alias("mean_length"), F.max(n).alias("max_length"), F.min(n).alias("min_length"), F.count_if(n.isNull()).alias("empty"))


def failure_bands(df: DataFrame, by: list[str], failed: Column) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"))
    rate = F.col("failures") * 100.0 / F.col("n")
    return out.withColumns({"failure_rate": rate, "severity": F.when(rate > 50, "severe").when(rate > 20, "moderate").otherwise("light")})


def composite(stats: DataFrame) -> DataFrame:
    """Mean less half a point for each percent of stale law and 0.3 for each percent of empty answers; the best is the
    first of the greatest, if above -1."""
    return stats.withColumn("composite", F.col("mean_score") - 0.5 * F.col("stale_rate") * 100 - 0.3 * F.col("refusal_rate") * 100)


def reliability_gate(stats: DataFrame, threshold: float = 0.01) -> DataFrame:
    return stats.withColumn("passes", F.col("stale_rate") <= threshold)


def pareto(stats: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mean, stale rate and tokens of each model, and whether another is as good in mean and stale rate and better in one."""
    points = stats.join(tokens, "model", "left").select("model", "mean_score", "stale_rate", "avg_total")
    return skyline(materialise(points, "points"), "mean_score", "stale_rate")
