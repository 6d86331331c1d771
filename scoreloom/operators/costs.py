"""Tokens and money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V


def price_book(spark: SparkSession, prices: tuple[tuple[str, float, float], ...] = V.PRICES) -> DataFrame:
    """Yuan for a million tokens in and out."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(prices)], "provider_no int, provider string, price_in double, price_out double")


def running_cost(tokens_in: Column, tokens_out: Column, reasoning: Column, price_in: float = V.RUNNING_PRICES[0], price_out: float = V.RUNNING_PRICES[1]) -> Column:
    """Reasoning tokens are billed as output, on top of it."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out + reasoning / 1e6 * price_out


def projected_costs(totals: DataFrame, prices: DataFrame, cases: int = 100, measured_cases: int = 5, fallback: tuple[int, int] = V.FALLBACK_CASE_TOKENS) -> DataFrame:
    """Cost of ``cases`` cases for each provider from measured totals ``(tokens_in, tokens_out)``, or the
    fallback for a case where nothing was measured. Both sides are a few rows."""
    per_case = [F.when(F.coalesce(c, F.lit(0)) > 0, c / measured_cases).otherwise(F.lit(float(f))) for c, f in zip((F.col("tokens_in"), F.col("tokens_out")), fallback, strict=True)]
    counted = totals.select(*[F.floor(c * cases).cast("long").alias(n) for c, n in zip(per_case, ("tokens_in", "tokens_out"), strict=True)])
    cost = counted.crossJoin(F.broadcast(prices)).withColumns({"cost_in": F.col("tokens_in") / 1e6 * F.col("price_in"), "cost_out": F.col("tokens_out") / 1e6 * F.col("price_out")})
    return cost.withColumn("cost", F.round(F.col("cost_in") + F.col("cost_out"), 2))


def token_averages(calls: DataFrame, by: list[str]) -> DataFrame:
    return calls.groupBy(*by).agg(F.avg("tokens_in").alias("avg_in"), F.avg("tokens_out").alias("avg_out"), F.avg("tokens_total").alias("avg_total"), F.count("*").alias("calls"))


def token_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    return calls.groupBy(*by).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("tokens_total").alias("tokens_total"), F.count("*").alias("calls"))


def with_fallback(current: DataFrame, other: DataFrame) -> DataFrame:
    """Token records of ``current``; where one has no total, the whole record of ``other``."""
    fields = ["avg_in", "avg_out", "avg_total", "calls"]
    a = current.select("model", F.struct(*fields).alias("mine"))
    b = other.select("model", F.struct(*fields).alias("theirs"))
    pick = F.when(F.col("mine.avg_total").isNull() & F.col("theirs").isNotNull(), F.col("theirs")).otherwise(F.col("mine"))
    return a.join(b, "model", "full").select("model", pick.alias("t")).select("model", "t.*")


def efficiency(stats: DataFrame, tokens: DataFrame) -> DataFrame:
    """Score points for a thousand tokens; models without token data have none."""
    return stats.join(tokens, "model", "left").withColumn("efficiency", F.try_divide(F.col("mean_score"), F.col("avg_total")) * 1000)


def token_frame(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted model with its tokens, or zeros and ``available`` false."""
    return wanted.join(tokens, "model", "left").select("model", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_in", "avg_out", "avg_total")], F.col("avg_total").isNotNull().alias("available"))


def marker_size(total: Column, lo: float = 3000.0, hi: float = 6000.0, small: float = 140.0, large: float = 420.0) -> Column:
    share = F.least(F.greatest((total - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return small + share * (large - small)
