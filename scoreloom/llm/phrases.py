"""Phrases that recur, found by count-min sketches and counted exactly.

A text is lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, and those at blanks into words. A phrase of up to
five words is counted per language over all its occurrences inside pieces.

First pass: every task keeps a count-min sketch of its words and pairs of words, as the counters that aren't zero; Spark
merges the sketches, shard by shard of the counters, and one bit a counter says whether it reaches the least count. A
sketch never counts too little, so what does not reach it there is rare. Second pass: the same for phrases of three to five
words whose pairs all may be frequent. Third pass: only what survives is counted, exactly, in Spark. Whether a phrase
survives depends on the phrase alone, so all its occurrences are counted or none, and nothing frequent is lost.

The sketches widen with the number of counted things, up to ``MAX_BITS``, where the bits take 64 MB; beyond that, with the same
least count, more rare phrases survive and are counted in vain, and the result is the same.

Phrases are then scored by their weakest cut, and those that always stand in a longer one are subsumed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm import text as tx
from scoreloom.llm.storage import map_batches, materialise

LONGEST = 5
NO_LANG = "und"
#: Rows of counters of a sketch; bits of a row's width at least and at most; counters of a shard, which is a row in Spark.
ROWS, MIN_BITS, MAX_BITS, SHARD_BITS = 2, 16, 28, 16
#: What the counters of a row should hold on average, as a part of the least count.
LOAD = 1 / 4
#: Bytes of text that are looked at together, and counters that a task gathers before it adds them up.
PART, PENDING = 1 << 20, 1 << 21
#: Parts of a language that are scored and ranked apart at first.
_SALTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SOLID = ~_BREAK
_SOLID[[0x20, 0x09]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32

_SHARDS = "shard long, places binary, counts binary"
_BITS = "shard long, bits binary"
_COUNTED = "lang string, phrase string, words int, times long"


@dataclass
class Part:
    """Words of a stretch of text. ``key[n][i]`` names the phrase of ``n`` words from word ``i`` where ``whole[n][i]``: all in one
    piece, and begun before the stretch's end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    langs: np.ndarray
    key: dict[int, np.ndarray]
    whole: dict[int, np.ndarray]


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """First row, last row, bounds of the rows in ``data``, and where phrases may begin at the latest. A long text comes in several
    stretches, each with the words that follow it."""
    for i, j in tx.slices(offsets, PART):
        at, end = int(offsets[i]), int(offsets[j])
        while end - at > 2 * PART and j == i + 1:
            stop = at + PART
            while stop < end and _SOLID[data[stop]]:
                stop += 1
            reach = 4096
            while stop + reach < end and len(tx.word_bounds(data[stop : stop + reach], np.array([0, reach]), kind=_SOLID)[0]) < LONGEST + 1:
                reach *= 2
            yield i, j, np.array([at, min(stop + reach, end)]), stop
            at = stop
        yield i, j, np.concatenate(([at], offsets[i + 1 : j + 1])), end


def _parts(batch: pa.RecordBatch, longest: int) -> Iterator[Part]:
    data, offsets = tx.utf8(batch.column("text"))
    names = batch.column("lang").to_pylist()
    seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
    for i, _, bounds, stop in _stretches(data, offsets):
        part = data[bounds[0] : bounds[-1]]
        starts, ends = tx.word_bounds(part, bounds - bounds[0], kind=_SOLID)
        words = tx.run_hashes(part, starts, ends)
        doc = np.searchsorted(bounds - bounds[0], starts, "right") - 1
        breaks = np.cumsum(_BREAK[part], dtype=np.int64)[starts] if len(starts) else starts
        joined = (doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1])
        rows = i + doc
        seed = seeds[rows] if len(rows) else np.zeros(0, np.uint64)
        grown, whole = words.copy(), starts + bounds[0] < stop
        out = Part(part, starts, ends, rows, {1: tx.mix(grown ^ tx.mix(seed + np.uint64(1)))}, {1: whole})
        for n in range(2, longest + 1):
            m = max(len(words) - n + 1, 0)
            grown = grown[:m] * np.uint64(0xA24BAED4963EE407) + words[n - 1 :]
            whole = whole[:m] & joined[n - 2 :]
            out.key[n], out.whole[n] = tx.mix(grown ^ tx.mix(seed[:m] + np.uint64(n))), whole
        yield out


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each key in each row of a sketch."""
    mask = np.uint64((1 << bits) - 1)
    return [(keys & mask).astype(np.int64), ((keys >> np.uint64(64 - bits)) & mask).astype(np.int64) + (1 << bits)]


@dataclass
class Sieve:
    """Of a merged sketch one bit a counter: whether it reaches the least count."""

    bits: int
    packed: np.ndarray

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in _places(keys, self.bits):
            out &= (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _may_be_frequent(part: Part, pairs: Sieve, longer: Sieve | None, longest: int) -> dict[int, np.ndarray]:
    """For each length, the words from which a phrase starts that may be frequent."""
    out = {1: np.flatnonzero(part.whole[1]), 2: np.flatnonzero(part.whole[2])}
    for n in (1, 2):
        out[n] = out[n][pairs.passes(part.key[n][out[n]])]
    likely = np.zeros(len(part.starts), bool)
    likely[out[2]] = True
    # A pair after the stretch's end is no start, but takes part in phrases that begin before it.
    beyond = np.flatnonzero(~part.whole[1][: len(part.key[2])])
    likely[beyond] = pairs.passes(part.key[2][beyond])
    run = likely
    for n in range(3, longest + 1):
        m = len(part.key[n])
        run = run[:m] & likely[n - 2 : n - 2 + m]
        out[n] = np.flatnonzero(run & part.whole[n])
        if longer is not None:
            out[n] = out[n][longer.passes(part.key[n][out[n]])]
    return out


def _sum_up(pending: list[np.ndarray], top: int) -> np.ndarray:
    """Adds up counters given as place and count in one number, by place; counts stop at ``top``."""
    both = np.concatenate(pending)
    pending.clear()
    both.sort()
    at = (both >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    both &= np.uint64((1 << 32) - 1)
    total = np.minimum(np.add.reduceat(both, first), np.uint64(top))
    return (at[first].astype(np.uint64) << np.uint64(32)) | total


def _sketch(bits: int, pairs: Sieve | None, longest: int, least: int):
    """A task's sketch by shards, as places and counts of the counters that aren't zero. Counts stop at the least count, which is all
    that the merged sketch is asked for."""
    top = min(least, (1 << 32) - 1)
    narrow = np.uint8 if top < 1 << 8 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            for part in _parts(batch, 2 if pairs is None else longest):
                if pairs is None:
                    keys = np.concatenate([part.key[n][part.whole[n]] for n in (1, 2)])
                else:
                    found = _may_be_frequent(part, pairs, None, longest)
                    keys = np.concatenate([part.key[n][found[n]] for n in range(3, longest + 1)])
                if not len(keys):
                    continue
                for places in _places(keys, bits):
                    at, n = np.unique(places, return_counts=True)
                    pending.append((at.astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64))
                    waiting += len(at)
                if waiting > PENDING:
                    pending = [_sum_up(pending, top)]
                    waiting = 0
        if not pending:
            return
        both = _sum_up(pending, top)
        at, n = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64((1 << 32) - 1)).astype(narrow)
        shard = at >> SHARD_BITS
        cut = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(at)]))
        places, counts = (at & ((1 << SHARD_BITS) - 1)).astype(np.uint16), n
        for k in range(0, len(cut) - 1, 512):
            ends = cut[k : k + 513]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[ends[:-1]]), *(pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()) for x in (places, counts))],
                names=["shard", "places", "counts"],
            )

    return run


def _merge(least: int):
    """Adds up the shards, which come in order, and gives out a bit for each counter."""
    narrow = np.uint8 if least < 1 << 8 else np.uint32

    def row(shard: int, total: np.ndarray) -> pa.RecordBatch:
        packed = np.packbits(total >= least, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([packed], pa.binary())], names=["shard", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for shard, places, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "places", "counts")), strict=True):
                if shard != now:
                    if now is not None:
                        yield row(now, total)
                    now, total = shard, np.zeros(1 << SHARD_BITS, np.int64)
                total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, narrow)
        if now is not None:
            yield row(now, total)

    return run


def _sieve(base: DataFrame, things: int, pairs: Sieve | None, longest: int, least: int) -> Sieve:
    """The merged sketch's bits. ``things``: about how many are counted."""
    bits = min(max(MIN_BITS, math.ceil(math.log2(max(things, 1) / (LOAD * least)))), MAX_BITS)
    shards = map_batches(base, _sketch(bits, pairs, longest, least), _SHARDS)
    merged = map_batches(shards.repartition("shard").sortWithinPartitions("shard"), _merge(least), _BITS)
    size = 1 << (SHARD_BITS - 3)
    packed = np.zeros(ROWS << (bits - 3), np.uint8)
    for r in materialise(merged, "sketch").toLocalIterator():  # of a bounded size
        packed[r["shard"] * size : (r["shard"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return Sieve(bits, packed)


def _survivors(pairs: Sieve, longer: Sieve, longest: int):
    """Counts of the phrases that survive, and of all words of a language as a phrase of no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for part in _parts(batch, longest):
                where, phrases, words, times = [], [], [], []
                mine = part.langs[part.whole[1]]
                for row, n in zip(*np.unique(mine, return_counts=True), strict=True):
                    where.append(langs[row])
                    phrases.append("")
                    words.append(0)
                    times.append(n)
                folded = _FOLD[part.data].tobytes()
                for n, at in _may_be_frequent(part, pairs, longer, longest).items():
                    if not len(at):
                        continue
                    _, first, count = np.unique(part.key[n][at], return_index=True, return_counts=True)
                    at = at[first]
                    where += [langs[r] for r in part.langs[at]]
                    words += [n] * len(at)
                    times.append(count)
                    for a, b in zip(part.starts[at].tolist(), part.ends[at + n - 1].tolist(), strict=True):
                        raw = folded[a:b]
                        phrases.append(raw if n == 1 or (raw.count(b" ") == n - 1 and b"\t" not in raw) else b" ".join(raw.replace(b"\t", b" ").split(b" ")))
                raw = [p if isinstance(p, bytes) else p.encode() for p in phrases]
                raw = [p if b"  " not in p else b" ".join(filter(None, p.split(b" "))) for p in raw]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.string()), pa.array(raw, pa.binary()).cast(pa.string()), pa.array(words, pa.int32()), pa.array(np.hstack(times) if times else [], pa.int64())],
                    names=[x.split()[0] for x in _COUNTED.split(", ")],
                )

    return run


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = LONGEST) -> DataFrame:
    """``(lang, phrase, words, times)``: every phrase of 1 to ``longest`` words with ``least`` occurrences or more, and each
    language's number of words with no phrase (0 words, an empty text). A written table."""
    if not (1 <= least and 2 <= longest <= LONGEST):
        raise ValueError(f"at least one occurrence, and 2 to {LONGEST} words")
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") > 0)
    n_bytes = base.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    pairs = _sieve(base, n_bytes // 3, None, longest, least)
    longer = _sieve(base, n_bytes // 6, pairs, longest, least)
    counted = map_batches(base, _survivors(pairs, longer, longest), _COUNTED).groupBy("lang", "phrase", "words").agg(F.sum("times").alias("times"))
    return materialise(counted.where((F.col("times") >= least) | (F.col("words") == 0)), "frequent")


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, top: int = 2000, percent: int = 100) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``longest`` words with ``least``
    occurrences or more, of ``docs(lang, text, ...)``.

    ``a``, ``l`` and ``r`` count the phrase and both sides of its cut, ``n`` all words of the language. A cut's score is
    floor(1000 a n / (l r)); the lowest counts, of equal ones the one with the shortest first side. A phrase that stands inside a
    longer one of at least ``percent`` percent as many occurrences is left out. By score, then ``a``, both falling, then
    the phrase's bytes.

    A null language is ``und``. Null and empty texts have no words; very long ones are read stretch by stretch. Repeated
    rows count again; doc_ids are not looked at. An empty table gives an empty result. Other columns are ignored, whatever
    their names.
    """
    found = frequent_phrases(docs, least, longest)
    phrases = found.where("words > 0").select("lang", "phrase", "words", "times")
    several = phrases.where("words > 1")
    parts = F.split("phrase", " ")
    # Of all longer phrases that a phrase stands in, one a word longer occurs most often.
    inner = several.where("words > 2").select("lang", F.explode(F.array(F.array_join(F.slice(parts, 1, F.col("words") - 1), " "), F.array_join(F.slice(parts, 2, F.col("words") - 1), " "))).alias("phrase"), "times")
    around = materialise(inner.groupBy("lang", "phrase").agg(F.max("times").alias("around")), "around")
    open_ = several.join(around, ["lang", "phrase"], "left").where(f"around is null or cast(100 as decimal(5)) * around < cast({int(percent)} as decimal(9)) * times").drop("around")
    cut = open_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select("lang", "phrase", F.col("times").alias("a"), "k", F.array_join(F.slice(parts, 1, F.col("k")), " ").alias("left"), F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    side = phrases.where(F.col("words") < longest)
    cut = cut.join(side.select("lang", F.col("phrase").alias("left"), F.col("times").alias("l")), ["lang", "left"])
    cut = cut.join(side.select("lang", F.col("phrase").alias("right"), F.col("times").alias("r")), ["lang", "right"])
    # A language may have most of the phrases: its total is dealt to several tasks.
    totals = found.where("words = 0").select("lang", F.col("times").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)).cast("int")).join(totals, ["lang", "salt"])
    whole = {c: F.col(c).cast("decimal(19)") for c in ("a", "l", "r", "n")}
    score = F.expr("(1000 * a * n) div (l * r)")
    cut = cut.select("lang", "phrase", "k", *(v.alias(c) for c, v in whole.items())).withColumn("score", score)
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    scored = materialise(best.select("lang", "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score"))), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
