"""Exact quantiles, and means of what lies at or below them, of groups with any number of distinct values.

A mergeable sketch (KLL) of each group gives values that the wanted place lies between, with a wide margin. What lies below is only
counted and summed; what lies between, a few percent of a group, is counted by value and run through in order, over as many tasks
as it takes. Counts prove that the place does lie between; a group where a sketch missed it is run through as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.ranking import running
from scoreloom.scratch import materialise

#: Size of a sketch, whose error of rank is under 0.2 percent, and the margin on either side.
SKETCH, MARGIN = 1024, 0.01
#: Groups of fewer values, in which the margin is few values wide, are run through as a whole.
SMALL = 2000


def _select(rows: DataFrame, brackets: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(*by, q, n, below, below_sum, value)`` for each bracket, with a null value where it missed, and the counts of the values between,
    ``(*by, q, v, c)``."""
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    near = rows.join(brackets, by).where(v <= high)
    # All that lies below is one row a group, the rest a row a value.
    counts = near.groupBy(*by, "q", F.when(v >= low, v).alias("v")).agg(F.count("*").alias("c"), F.sum("v").alias("s"))
    counts = materialise(counts, "counts")
    inside = counts.where("v is not null").select(*by, "q", "v", "c")
    below = counts.groupBy(*by, "q").agg(
        F.coalesce(F.sum(F.when(v.isNull(), F.col("c"))), F.lit(0)).alias("below"), F.sum(F.when(v.isNull(), F.col("s"))).alias("below_sum"), F.coalesce(F.sum(F.when(v.isNotNull(), F.col("c"))), F.lit(0)).alias("inside")
    )
    counted = brackets.join(below, [*by, "q"], "left").na.fill(0, ["below", "inside"])
    ordered = running(inside, [*by, "q"], [v], {"cum": F.col("c")}).join(counted, [*by, "q"])
    place = F.col("q") * (F.col("n") - 1)
    upto = F.col("below") + F.col("cum")
    picked = ordered.groupBy(*by, "q").agg(F.min(F.when(upto > F.floor(place), v)).alias("v0"), F.min(F.when(upto > F.ceil(place), v)).alias("v1"))
    good = (F.col("below") <= F.floor(place)) & (F.ceil(place) < F.col("below") + F.col("inside"))
    found = counted.join(picked, [*by, "q"], "left").withColumn("value", F.when(good, F.col("v0") + (place - F.floor(place)) * (F.col("v1") - F.col("v0"))))
    return materialise(found.select(*by, "q", "n", "below", "below_sum", "value"), "quantiles"), inside


def _with_tail(found: DataFrame, inside: DataFrame, by: list[str]) -> DataFrame:
    tail = inside.join(found.select(*by, "q", "value"), [*by, "q"]).where("v <= value").groupBy(*by, "q").agg(F.sum("c").alias("tail_n"), F.sum(F.col("c") * F.col("v")).alias("tail_sum"))
    total = F.coalesce("below_sum", F.lit(0.0)) + F.coalesce("tail_sum", F.lit(0.0))
    mean = F.try_divide(total, F.col("below") + F.coalesce("tail_n", F.lit(0)))
    return found.join(tail, [*by, "q"], "left").select(*by, "q", "n", "value", mean.alias("tail_mean"))


def exact_quantiles(df: DataFrame, by: list[str], value: Column, probabilities: list[float], written: bool = False) -> DataFrame:
    """``(*by, q, n, value, tail_mean)``: for each group and probability the interpolated quantile of its values, how many values there are, and
    the mean of those at or below the quantile. Nulls and NaN are no values; a group without any is left out. Null keys are left out.
    ``written``: ``df`` is a table of its own, which may be read again and again."""
    if any(not 0 <= q <= 1 for q in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    rows = df.select(*by, value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).dropna(subset=by)
    rows = rows if written else materialise(rows, "values")
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("v", F.lit(SKETCH)).alias("sketch"))

    def at(q: float, end: str) -> Column:
        found = F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(q, 0.0), 1.0)))
        return F.when(F.col("n") < SMALL, float(end)).otherwise(found)

    each = F.array(*[F.struct(F.lit(float(q)).alias("q"), at(q - MARGIN, "-inf").alias("low"), at(q + MARGIN, "inf").alias("high")) for q in probabilities])
    brackets = materialise(sketch.select(*by, "n", F.inline(each)), "brackets")
    found, inside = _select(rows, brackets, by)
    missed = found.where("value is null")
    out = _with_tail(found.where("value is not null"), inside, by)
    if not missed.isEmpty():
        wide = missed.select(*by, "q", "n", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
        out = out.unionByName(_with_tail(*_select(rows, materialise(wide, "brackets"), by), by))
    return out


def skyline(df: DataFrame, high: str, low: str, name: str = "dominated") -> DataFrame:
    """Adds whether another row is as good in both ``high`` (more is better) and ``low`` (less is better) and better in one. Rows with a null in
    either are neither. By a sort and a running minimum over the distinct values of ``high``, not by pairs."""
    steps = df.where(F.col(high).isNotNull() & F.col(low).isNotNull()).groupBy(F.col(high).alias("__high")).agg(F.min(low).alias("__best"))
    # The least ``low`` among rows that have more: the running minimum up to the step before.
    stairs = running(steps, [], [F.col("__high").desc()], {"__n": F.lit(1).cast("long")}, lows={"__upto": F.col("__best")})
    before = stairs.select((F.col("__n") + 1).alias("__n"), F.col("__upto").alias("__above"))
    stairs = materialise(stairs.join(before, "__n", "left").select("__high", "__best", "__above"), "stairs")
    beaten = (F.col("__above") <= F.col(low)) | (F.col("__best") < F.col(low))
    return df.join(stairs, F.col(high) == F.col("__high"), "left").withColumn(name, F.coalesce(beaten, F.lit(False))).drop("__high", "__best", "__above")
