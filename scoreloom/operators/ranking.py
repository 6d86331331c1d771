"""Orders, ranks, top-k, look-back counts. Every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.scratch import materialise


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """1-based place in a table of any size: a range-partitioned sort, written, then each row's place in its partition plus
    the sizes of the partitions before."""
    placed = materialise(df.sort(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    # One row a sorted partition, however many rows there are.
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.cast("long").alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    parts = df.sparkSession.createDataFrame(before, "__p long, __before long")
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(parts), part == F.col("__p")).withColumn(name, place).drop("__at", "__p", "__before")


def rank(df: DataFrame, *order: Column, within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based place by ``order``; without ``within`` meant for tables of a row a model, else see ``numbered``."""
    window = (W.partitionBy(*within) if within else W.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window))


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], totals: dict[str, Column] | None = None, lows: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for each of ``sums``, the sum over the rows of the same keys up to and with this one, for each of ``lows`` the least value there, and
    for each of ``totals`` an aggregate over all rows of the keys; for keys of any size, or one order of all rows without keys. The
    order is total; null keys are keys, null values count 0 in sums and are passed over in lows.

    A range-partitioned sort by (keys, order) splits a large key over as many tasks as it needs. Each task sums its own stretch of each
    key; what the stretches before it came to is carried in. Only keys that go over a border have such a carry: two rows a border
    at most, so that table is as small as the number of tasks and is broadcast.
    """
    totals, lows = totals or {}, lows or {}
    placed = materialise(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "stretches")
    same = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))
    each = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()] + [F.min(c).alias(name) for name, c in lows.items()]
    stretches = placed.groupBy(same.alias("__same"), "__part").agg(*each)
    split = stretches.groupBy("__same").agg(F.sort_array(F.collect_list(F.struct("__part", *sums, *lows))).alias("s")).where(F.size("s") > 1)  # stretches of a key, not rows
    kinds = {f.name: f.dataType for f in stretches.schema.fields}
    zeros = {name: F.lit(0).cast(kinds[name]) for name in sums}

    def carried(name: str) -> Column:
        earlier = F.transform(F.filter("s", lambda x: x["__part"] < F.col("__at")), lambda x: x[name])
        return F.array_min(earlier) if name in lows else F.aggregate(earlier, zeros[name], lambda t, x: t + x)

    carry = split.withColumn("__at", F.explode("s.__part")).select("__same", F.col("__at").alias("__part_"), *[carried(n).alias(f"__{n}") for n in (*sums, *lows)])
    window = W.partitionBy("__part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = placed.withColumns({name: F.sum(F.coalesce(c, F.lit(0))).over(window) for name, c in sums.items()} | {name: F.min(c).over(window) for name, c in lows.items()})
    own = own.join(F.broadcast(carry), F.col("__same").eqNullSafe(same) & (F.col("__part") == F.col("__part_")), "left")
    whole = {name: F.col(name) + F.coalesce(F.col(f"__{name}"), zeros[name]) for name in sums} | {name: F.least(name, f"__{name}") for name in lows}
    own = own.withColumns(whole).drop("__same", "__part", "__part_", *[f"__{n}" for n in whole])
    if not totals:
        return own
    every = materialise(placed.groupBy(same.alias("__same")).agg(*[c.alias(n) for n, c in totals.items()]), "totals")
    return own.join(every, F.col("__same").eqNullSafe(same)).drop("__same")


def numbered_within(df: DataFrame, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """1-based place in each key, for keys of any size."""
    return running(df, keys, list(order), {name: F.lit(1).cast("long")})


def pinned_last(name: str, pin: str) -> Column:
    """Sort key that puts one name behind all others."""
    return (F.col(name) == pin).cast("int")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_rows(df: DataFrame, keys: list[str], order: str, n: int, at_least: int = 0) -> DataFrame:
    """The first ``n`` rows of each key, for keys with ``at_least`` rows."""
    window = W.partitionBy(*keys)
    placed = df.withColumns({"rn": F.row_number().over(window.orderBy(order)), "cnt": F.count("*").over(window)})
    return placed.where((F.col("rn") <= n) & (F.col("cnt") >= at_least)).drop("rn", "cnt")


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the first by ``order``."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def sample_rows(df: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    """``n`` rows by a hash of their key: the same ones in every run."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def progress(df: DataFrame, task: str, ts: str, key: str) -> DataFrame:
    """Done so far, of all, percent and seconds left at the pace until then, after each event of a task of any size."""
    df = running(df, [task], [F.col(ts), F.col(key)], {"done": F.lit(1).cast("long")}, {"all_n": F.count("*"), "began": F.min(ts)})
    elapsed = _micros(ts) - _micros("began")
    return df.withColumns({"pct": F.floor(F.col("done") * 100 / F.col("all_n")), "eta_s": F.floor(elapsed / F.col("done") * (F.col("all_n") - F.col("done")) / 1e6)}).drop("began")


def look_back(df: DataFrame, key: str, ts: str, seconds: int, name: str) -> DataFrame:
    """Events of the same key in the ``seconds`` before and at each event. Time is cut into spans of that length and each
    event counts in its own and the next one, so that a window holds two spans of a key and not the whole key."""
    micros, span = _micros(ts), seconds * 1_000_000
    own = F.floor(micros / span)
    both = df.withColumn("__own", own).withColumn("__span", F.explode(F.array(own, own + 1)))
    window = W.partitionBy(key, "__span").orderBy(micros).rangeBetween(-span, 0)
    return both.withColumn(name, F.count("*").over(window)).where(F.col("__span") == F.col("__own")).drop("__own", "__span")
