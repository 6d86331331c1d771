"""Removal of repeated byte strings by prefix doubling over sampled positions.

The strings that begin at a position are ranked by growing lengths. A rank stands for equal bytes: strings keep the rank
that they share, and the next one is that of the pair of this rank and the bytes by which the strings grow. Spark sorts the
pairs and numbers them; strings whose pair is unique drop out, those that have reached ``LENGTH`` bytes and still share
a rank repeat, and only what is neither goes on.

Ranking every position would move some twenty times the corpus a round, so positions are sampled by content. Up to 64
bytes tasks name strings alike without a shuffle (names of 1, 2, 4 ... 32 bytes paired at that offset). Of the 64-byte
names in every ``LENGTH``-byte string the smallest one is its mark, so equal ``LENGTH``-byte strings have equal marks at equal
places, and only marks, one position in about 69, are ranked. A mark stands for the run of string starts that chose it.

First rank: 64 bytes at the mark. Where all marks of a rank also agree in the whole stretch that the strings of their
run cover, every string of the run repeats, and the run is settled. Then runs are split into parts of at most 32, 8, 2 and
1 strings at fixed distances from the mark, whose common bytes grow from 169 to 193, 199 and 200; each time the pair
of the last rank and the common bytes (their 128-bit digest) is ranked. Equal stretches are ranked once, with their number
as weight.

Rows are known by two 64-bit hashes of their texts, so that a doc_id may be null or shared; rows of one text are asked and
answered together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import text as tx
from scoreloom.llm.keyfilter import key_bitmap, split
from scoreloom.llm.storage import map_batches, materialise

LENGTH = 200
GRAM = 64
WINDOW = LENGTH - GRAM + 1
#: String starts that are named at a time; longer documents are cut into overlapping pieces.
PIECE = 1 << 22
#: Most strings of a part in each round of splitting.
PARTS = (32, 8, 2, 1)
#: A text's name in all tables.
ROW = ["row", "alt"]
_STEP = np.uint64(0xA24BAED4963EE407)
_BYTE = tx.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _doubled(names: np.ndarray, offset: int) -> np.ndarray:
    """Names of the strings made of each one and the one ``offset`` further on."""
    out = names[:-offset] * _STEP
    out += names[offset:]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def names_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all 64-byte and all 128-byte strings."""
    names = _BYTE[data]
    for offset in (1, 2, 4, 8, 16, 32):
        names = _doubled(names, offset)
    return names, _doubled(names, 64)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every run of ``width``."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def marks_of(names: np.ndarray, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mark position, and first and last string start, of each run of string starts with the same mark. The
    leftmost of equal names is the mark. ``valid``: starts that count."""
    at = np.arange(len(names), dtype=np.uint64)
    keyed = (names & np.uint64(0xFFFFFFFFFF000000)) | at  # 40 bits of the name, then the place
    low = (window_minimum(keyed, WINDOW) & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.arange(len(low))
    if valid is not None:
        low, starts = low[valid], starts[valid]
    if not len(low):
        return low, low, low
    new = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (starts[1:] != starts[:-1] + 1))))
    return low[new], starts[new], starts[np.append(new[1:], len(low)) - 1]


def stretch_names(names128: np.ndarray, mark: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Names of the bytes that the strings from ``first`` to ``last`` cover, and of their place at the mark."""
    end = last + LENGTH - 128
    out = names128[first] * _STEP + names128[np.minimum(first + 128, end)]
    out = tx.mix(out) * _STEP + names128[end]
    return tx.mix(tx.mix(out) + ((last - first).astype(np.uint64) << np.uint64(20)) + (mark - first).astype(np.uint64))


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, the row and the position in its document of each piece's first bytes, and where documents end in it:
    several short documents, or a part of a long one that overlaps the next by ``LENGTH`` - 1."""
    for i, j in tx.slices(offsets):
        lo, hi = offsets[i], offsets[j]
        if hi - lo <= PIECE or j - i > 1:
            yield data[lo:hi], np.arange(i, j), offsets[i : j + 1] - lo, np.zeros(j - i, np.int64)
            continue
        for at in range(0, int(hi - lo) - LENGTH + 1, PIECE):
            part = data[lo + at : min(hi, lo + at + PIECE + LENGTH - 1)]
            yield part, np.array([i]), np.array([0, len(part)]), np.array([at])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.utf8(batch.column("text"))
        ids, alts = batch.column("row").to_numpy(), batch.column("alt").to_numpy()
        for part, rows, ends, shift in _pieces(data, offsets):
            if len(part) < LENGTH:
                continue
            names, longer = names_of(part)
            length = np.diff(ends)
            count = np.maximum(length - LENGTH + 1, 0)  # string starts of each document
            valid = np.repeat(ends[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            mark, first, last = marks_of(names, valid)
            doc = np.searchsorted(ends, first, "right") - 1
            move = shift[doc] - ends[doc]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[rows[doc]]),
                    pa.array(alts[rows[doc]]),
                    pa.array(names[mark].view(np.int64)),
                    pa.array(stretch_names(longer, mark, first, last).view(np.int64)),
                    pa.array(first + move),
                    pa.array((last - first).astype(np.int16)),
                    pa.array((mark - first).astype(np.int16)),
                ],
                names=[x.split()[0] for x in _MARKS.split(", ")],
            )


_MARKS = "row long, alt long, name long, stretch long, first long, more short, lead short"


_BYTES = "row long, alt long, run long, raw binary"


def _run_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that the strings of each asked run cover."""
    for batch in batches:
        data, offsets = tx.utf8(batch.column("text"))
        rows, alts, runs = (batch.column(c).to_pylist() for c in ("row", "alt", "runs"))
        out = []
        for i, asked in enumerate(runs):
            raw = data[offsets[i] : offsets[i + 1]]
            out += [(rows[i], alts[i], r["first"], raw[r["first"] : r["first"] + r["more"] + LENGTH].tobytes()) for r in asked]
        yield _batch(out, _BYTES)


def _split(size: int):
    """Parts of runs by the strings' distance to the mark, ``size`` at most, with their common bytes' digest and their
    stretch's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, alt, start, first, more, lead, rank, weight, raw in zip(*(batch.column(c).to_pylist() for c in (*ROW, "run", "first", "more", "lead", "rank", "weight", "raw")), strict=True):
                mark = first - start + lead  # in raw
                for block in range((lead - more) // size, lead // size + 1):
                    low, high = block * size, block * size + size - 1
                    near, far = max(low, lead - more), min(high, lead)
                    common = raw[mark - low : mark - high + LENGTH]
                    stretch = xxhash.xxh3_64_intdigest(raw[mark - far : mark - near + LENGTH], seed=far * 256 + near) - (1 << 63)
                    out.append((row, alt, start, first + lead - far, far - near, far, rank, block, xxhash.xxh3_128_digest(common), stretch, weight))
                if len(out) >= 20000:
                    yield _batch(out, _PARTS)
                    out = []
            yield _batch(out, _PARTS)

    return run


_PARTS = "row long, alt long, run long, first long, more short, lead short, rank long, block int, common binary, stretch long, weight long"
_KINDS = {"long": pa.int64(), "short": pa.int16(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.utf8(batch.column("text"))
        removed, spans, digests = [], [], []
        for i, runs in enumerate(batch.column("runs").to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]]
            if not runs or not len(raw):
                removed.append(0)
                spans.append(0)
                digests.append(hashlib.sha256(raw.tobytes()).hexdigest())
                continue
            steps = np.zeros(len(raw) + 1, np.int64)
            first = np.array([r["first"] for r in runs])
            np.add.at(steps, np.minimum(first, len(raw)), 1)
            np.subtract.at(steps, np.minimum(first + np.array([r["more"] for r in runs]) + LENGTH, len(raw)), 1)
            gone = np.cumsum(steps[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
            digests.append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _rank(rows: DataFrame, pair: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Ranks the rows by ``pair``, the rank so far and what the strings grow by. Returns settled ``(row, alt, first, more)``, and
    what shares a rank but neither repeats wholly nor not at all: one row a stretch, with its weight."""
    shared = rows.groupBy(*pair).agg(F.sum("weight").alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("n > 1")
    # Sorted and written: the place is the new rank, and the join below can deal both sides anew and split a rank that many rows share.
    shared = shared.select(*pair, (F.col("low") == F.col("high")).alias("alike"))
    ranks = materialise(shared.sort(*pair).withColumn("new", F.monotonically_increasing_id()), "ranks")
    survivors = materialise(rows.join(ranks, pair).drop(*pair).withColumnRenamed("new", "rank"), "shared")
    mixed = survivors.where("not alike")
    one = F.min(F.struct(*ROW, "run", "first", "more", "lead")).alias("one")
    stretches = materialise(mixed.groupBy("rank", "stretch").agg(F.sum("weight").alias("weight"), one), "stretches")
    twice = stretches.where("weight > 1").select("rank", "stretch")
    settled = [survivors.where("alike"), mixed.join(twice, ["rank", "stretch"], "left_semi")]
    return [s.select(*ROW, "first", "more") for s in settled], stretches.select("one.*", "rank", "weight")


def _runs_of(rows: DataFrame) -> DataFrame:
    """``(row, alt, runs)``: each text's runs, once each."""
    return rows.groupBy(*ROW).agg(F.collect_set(F.struct("first", "more")).alias("runs"))  # one text's


def repeated_runs(base: DataFrame) -> DataFrame:
    """``(row, alt, first, more)``: runs of string starts, in bytes, whose ``LENGTH``-byte strings start elsewhere
    too, for ``base(row, alt, text)``."""
    marks = materialise(map_batches(base.where(F.octet_length("text") >= LENGTH).select(*ROW, "text"), _marks, _MARKS), "marks")
    settled, open_ = _rank(marks.withColumn("run", F.col("first")).withColumn("weight", F.lit(1).cast("long")), ["name"])
    asked = materialise(_runs_of(open_), "asked")
    candidates, _ = split(base.select(*ROW, "text"), "row", key_bitmap(asked, "row"))
    raw = map_batches(candidates.join(asked, ROW), _run_bytes, _BYTES).groupBy(*ROW, "run").agg(F.min("raw").alias("raw"))
    raw = materialise(raw, "run-bytes")
    for size in PARTS:
        parts = materialise(map_batches(open_.join(raw, [*ROW, "run"]), _split(size), _PARTS), "parts")
        more, open_ = _rank(parts, ["rank", "block", "common"])
        settled += more
    return reduce(DataFrame.unionByName, settled)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row of ``docs(doc_id, text, ...)``: each byte
    covered by a ``LENGTH``-byte string that also starts anywhere else, in any row, goes.

    Null and empty texts have no bytes; very long ones are read whole, a piece at a time. Repeated rows are documents of
    their own, so all their strings repeat, and so do those of rows that share a text but not a doc_id. A null doc_id is
    passed through; rows of one doc_id may have different texts. Strings that tie all go, none of them stays as the
    first. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("alt"))
    runs = materialise(_runs_of(repeated_runs(base)), "runs")
    maybe, rest = split(base, "row", key_bitmap(runs, "row"))
    whole = rest.select("doc_id", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    joined = maybe.join(runs, ROW, "left").select("doc_id", "text", "runs")
    return map_batches(whole.unionByName(joined), _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
