"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies that each of its documents should have. The
fractional part is rounded without losing the source's total: documents are paired, words move at random from
one to the other, in expectation-keeping proportions, until one of the two is taken wholly or not at all; the
other one goes on to the next pair. Blocks of documents do this independently; the one undecided document of
each block goes to the next level, so a reduction tree ends in one undecided document a source, which
gives only its remaining words. A sort of the whole table numbers each source's documents, and blocks are ranges of those
numbers, so that no block is larger than another, however many rows repeat or lack a doc_id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.storage import materialise

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
CAP = 2.0
BLOCK = 4096
_EPS = 1e-9
_COLUMNS = ["doc_id", "source", "size", "source_size", "target", "taken", "mass", "place"]
_DONE = "doc_id long, source string, size long, source_size long, target double, taken long, mass double, place long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place, from 0, in a range-partitioned sort: its place in its partition plus the sizes of the
    partitions before."""
    placed = materialise(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    # One row a sorted partition, however many rows there are.
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.cast("long").alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    parts = df.sparkSession.createDataFrame(before, "p long, before long")
    row = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(parts), part == F.col("p")).withColumn(name, F.col("before") + row).drop("at", "p", "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``: ``budget`` times all sizes, shared by weight;
    a target stops at ``cap`` times its source's size and the excess is shared again until none is above."""
    choice = F.array(*[F.lit(float(w)) for w in weights])
    ranked = _numbered(sizes.select("source", "size"), [F.col("source").asc_nulls_last()], "rank")
    weighed = materialise(ranked.select("source", "size", F.element_at(choice, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).alias("w")), "weights")
    limit = F.col("size") * F.lit(cap)
    total = weighed.agg(F.sum("size").alias("n")).first()["n"] or 0
    level = 0.0
    while True:
        full = F.col("w") * F.lit(level) >= limit
        row = weighed.agg(F.sum(F.when(full, limit).otherwise(0.0)).alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        free = budget * total - (row["fixed"] or 0.0)
        if not row["w"] or free / row["w"] <= level:
            break
        level = free / row["w"]
    return weighed.select("source", F.col("size").alias("source_size"), F.least(F.col("w") * F.lit(level), limit).alias("target"))


def _settle(seed: int, level: int):
    """Pair the documents of one block; ``mass`` is a document's undecided words, between 0 and its size.
    All but one end with none: their ``taken`` is final, and ``mass`` null."""

    def run(table: pa.Table) -> pa.Table:
        table = table.select(_COLUMNS).sort_by("place")
        whole, size = table.column("size").to_numpy(), table.column("size").to_numpy().astype(float)
        mass = table.column("mass").to_numpy().copy()
        draws = np.random.Generator(np.random.PCG64([seed, level, table.column("place")[0].as_py(), len(mass)])).random(len(mass))

        def undecided(i: int) -> bool:
            return _EPS * size[i] < mass[i] < size[i] * (1 - _EPS)

        held = -1
        for j in range(len(mass)):
            if not undecided(j):
                continue
            if held < 0:
                held = j
                continue
            up = min(size[held] - mass[held], mass[j])  # held gains what j loses
            down = min(mass[held], size[j] - mass[j])
            step = up if draws[j] * (up + down) < down else -down
            mass[held], mass[j] = mass[held] + step, mass[j] - step
            held = held if undecided(held) else (j if undecided(j) else -1)
        extra = np.where(mass >= size / 2, whole, 0)
        left = np.full(len(mass), np.nan)
        if held >= 0:
            left[held], extra[held] = mass[held], 0
        taken = pa.array(table.column("taken").to_numpy() + extra)
        table = table.set_column(_COLUMNS.index("taken"), "taken", taken)
        return table.set_column(_COLUMNS.index("mass"), "mass", pa.array(left, from_pandas=True))

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = 17) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row of ``docs(doc_id, text, source, ...)``.

    ``size`` counts words (null text: 0); ``taken`` the words the mix takes of the row, repeats counted.
    A null source is a source of its own, last in order; a null doc_id is passed through. Rows that repeat are separate
    documents, and which of several equal ones is taken more often makes no difference. Empty texts have no words and
    are never taken; very long ones count whole. Sources without words have target 0. An empty table gives an empty
    result. Other columns are ignored. Reruns agree: the random draws depend on ``seed`` and the rows only, not on how they
    are partitioned.
    """
    spark: SparkSession = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    sized = materialise(base, "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    sources = materialise(sources, "by-source")
    targets = source_targets(sources.select("source", "size"), weights, budget, cap).withColumnRenamed("source", "s")
    goal = materialise(targets.join(sources.select("source", "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("source"), "goals")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    numbered = _numbered(sized, [F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("size")], "place")
    first = materialise(numbered.groupBy(F.col("source").alias("f")).agg(F.min("place").alias("first")), "firsts")
    level = (
        numbered.join(goal, F.col("source").eqNullSafe(F.col("s")))
        .join(first, F.col("source").eqNullSafe(F.col("f")))
        .withColumn("copies", copies)
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.floor("copies") * F.col("size")).alias("taken"),
            ((F.col("copies") - F.floor("copies")) * F.col("size")).alias("mass"),
            (F.col("place") - F.col("first")).alias("place"),
        )
    )
    largest = sources.agg(F.max("rows")).first()[0] or 0
    done = []
    while largest > 0:
        # The block's number is the place of its undecided document on the next level.
        block = F.floor(F.col("place") / BLOCK).alias("block")
        settled = level.groupBy("source", block).applyInArrow(_settle(seed, len(done)), _DONE)
        settled = materialise(settled, "settled")
        last = largest <= BLOCK
        if last:  # the document left at a source's root gives its remaining words
            done.append(settled.withColumn("taken", F.col("taken") + F.coalesce(F.round("mass").cast("long"), F.lit(0))))
            break
        done.append(settled.where("mass is null"))
        level = settled.where("mass is not null").withColumn("place", F.floor(F.col("place") / BLOCK))
        largest = -(-largest // BLOCK)
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    if not done:
        return spark.createDataFrame([], "doc_id long, source string, size long, source_size long, target double, taken long")
    return reduce(DataFrame.unionByName, done).select(*columns)
