"""Exact quantiles and tails, bootstrap intervals and skylines of groups of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import quantiles, stats


def brute(x, q):
    value = np.quantile(x, q)
    return len(x), value, x[x <= value].mean()


def frame(spark, groups):
    import pandas as pd

    return spark.createDataFrame(pd.concat([pd.DataFrame({"g": g, "x": x}) for g, x in groups.items()]), "g string, x double")


def test_a_million_distinct_scores(spark):
    rng = np.random.default_rng(1)
    groups = {"many": rng.gamma(2.0, 3.0, 1_000_000), "grid": np.round(rng.random(50_000) * 20, 2), "few": np.array([2.6, 5, 7, 9]), "one": np.array([3.0]), "same": np.full(1000, 7.5)}
    got = {(r["g"], r["q"]): r for r in quantiles.exact_quantiles(frame(spark, groups), ["g"], F.col("x"), [0.0, 0.1, 0.5, 1.0]).collect()}
    for g, x in groups.items():
        for q in (0.0, 0.1, 0.5, 1.0):
            n, value, tail = brute(x, q)
            r = got[g, q]
            assert r["n"] == n and r["value"] == pytest.approx(value, rel=1e-12) and r["tail_mean"] == pytest.approx(tail, rel=1e-9), (g, q)


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    rng = np.random.default_rng(2)
    groups = {f"g{k}": rng.normal(k, 1, 20_000) for k in range(3)}
    monkeypatch.setattr(quantiles, "MARGIN", -0.01)  # the bracket's ends change places
    got = {r["g"]: r for r in quantiles.exact_quantiles(frame(spark, groups), ["g"], F.col("x"), [0.1]).collect()}
    for g, x in groups.items():
        _, value, tail = brute(x, 0.1)
        assert got[g]["value"] == pytest.approx(value, rel=1e-12) and got[g]["tail_mean"] == pytest.approx(tail, rel=1e-9)


def test_quantile_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None), (None, 2.0), ("c", float("-inf")), ("c", 5.0)], "g string, x double")
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], F.col("x"), [1.0]).collect()}
    assert set(got) == {"a", "c"} and got["a"]["value"] == 1.0 and got["a"]["n"] == 1 and got["c"]["value"] == 5.0
    assert quantiles.exact_quantiles(df.limit(0), ["g"], F.col("x"), [0.1]).count() == 0
    with pytest.raises(ValueError, match="between"):
        quantiles.exact_quantiles(df, ["g"], F.col("x"), [1.5])


def test_model_statistics_of_any_number_of_scores(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.random(30_000) * 20
    texts = {c: None for c in ("minor", "moderate", "major", "error_flag")}
    rows = pd.DataFrame({"model": "m", "total": x, "answer": "a", "rationale": "ok", **texts, **{d: 1.0 for d in stats.D}})
    row = stats.model_stats(spark.createDataFrame(rows, "model string, total double, answer string, rationale string, minor string, moderate string, major string, error_flag string, d1 double, d2 double, d3 double, d4 double, d5 double")).first()
    _, value, tail = brute(x, 0.1)
    assert row["p10"] == pytest.approx(value) and row["cvar10"] == pytest.approx(tail) and row["n"] == 30_000


def test_bootstrap_of_distinct_scores(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(10, 3, 4000), "b": np.round(rng.random(3000) * 20, 1)}
    df = frame(spark, groups)
    got = {r["g"]: r for r in stats.bootstrap_means(df, by="g", score="x").collect()}
    exact = {r["g"]: r for r in stats.bootstrap_exact(df, 2000, by="g", score="x").collect()}
    for g, x in groups.items():
        width = exact[g]["high"] - exact[g]["low"]
        assert got[g]["mean"] == pytest.approx(x.mean()) and abs(got[g]["low"] - exact[g]["low"]) < 0.1 * width and abs(got[g]["high"] - exact[g]["high"]) < 0.1 * width
    again = {r["g"]: r for r in stats.bootstrap_means(df.repartition(7), by="g", score="x").collect()}
    assert got == again and "Collect" not in str(df)


def test_skyline_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    high, low = rng.random(100_000), rng.random(100_000)
    high[:40_000] = np.round(high[:40_000], 3)  # many alike
    low[20_000:60_000] = np.round(low[20_000:60_000], 2)
    low[60_000:] = high[60_000:] + 0.1 * low[60_000:]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(100_000), "h": high, "l": low}))
    got = quantiles.skyline(df, "h", "l").toPandas().sort_values("i")
    order = np.lexsort((low, -high))
    beaten, above, best, last = np.zeros(100_000, bool), np.inf, np.inf, None
    for i in order:
        if high[i] != last:
            above, last, best = min(above, best), high[i], low[i]
        beaten[i] = above <= low[i] or best < low[i]
    assert (got["dominated"].to_numpy() == beaten).all() and 0 < (~beaten).sum() < 5000
    some = rng.choice(100_000, 300, replace=False)
    for i in some:  # and of the definition itself
        better = (high >= high[i]) & (low <= low[i]) & ((high > high[i]) | (low < low[i]))
        assert beaten[i] == better.any()


def test_skyline_edges(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 1.0), (3, 1.0, None), (4, None, 0.0), (5, 1.0, 1.0)], "i int, h double, l double")
    assert {r["i"]: r["dominated"] for r in quantiles.skyline(df, "h", "l").collect()} == {1: False, 2: False, 3: False, 4: False, 5: True}
    assert quantiles.skyline(df.limit(0), "h", "l").count() == 0
