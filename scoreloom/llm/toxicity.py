"""Toxicity by a factorization machine over hashed terms.

A text's terms, and their first 4, 6 and 8 bytes for inflected and compound words, are hashed into 2^18 cells, present
or not; further cells tell that a term occurs often, that several terms share a beginning, and how long the text is. A
cell has a linear weight and a short factor vector; the score adds the products of the factors of all pairs of cells,
so that a pair, such as an insult together with a group mention, can count for more or less than its members. The
model is fitted on a bounded sample of the labelled rows (``max_positive`` and ``max_negative`` rows) and its output is
calibrated on rows held back from it, both labels weighing alike.

Spark counts the sample's cells by label. The driver sees one count a cell and chooses all that tell something
by themselves, and the ``PAIRED`` that most sampled rows have. Among the latter it looks for pairs that tell more together
than apart, whatever each tells by itself, and the members of all such pairs join the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import text as tx
from scoreloom.llm.calibration import calibrate_at, sigmoid
from scoreloom.llm.storage import map_batches, materialise

HASH_BITS = 18
PREFIXES = (4, 6, 8)
FACTORS = 4
#: Deviations of its log odds from the mean that a cell needs, and of a pair from its members.
STRENGTH, LEAST_DEVIATION = 2.5, 6.0
#: Cells of the sample whose pairs are looked at: their counts by pairs are a matrix on the driver.
PAIRED = 512
#: Times from which on a term is frequent in its text.
OFTEN = 3
#: Rows that a cell must be in to be one of them.
LEAST_ROWS = 5
#: Share of a row's cells that a training step sees, so that few of them must do.
SEEN = 0.6
THRESHOLD = 0.7
MAX_POSITIVE, MAX_NEGATIVE = 4000, 8000
_CELLS = np.uint64((1 << HASH_BITS) - 1)


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never used."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def term_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ranges of rows: the first row, a line of hashes for each term, and each row's first line. Case is folded in
    ASCII and Latin-1 letters."""
    data, offsets = tx.utf8(column)
    data = tx.fold_latin(data)
    for i, j in tx.slices(offsets):
        yield i, *tx.term_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], PREFIXES)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _CELLS).astype(np.int64)


def _twice(cells: np.ndarray) -> np.ndarray:
    """Cells that stand for two or more terms with one beginning."""
    return (cells * 0x2C1B3C6D + 7) & int(_CELLS)


def _often(cells: np.ndarray) -> np.ndarray:
    """Cells that stand for a term, or a beginning, which occurs ``OFTEN`` times."""
    return (cells * 0x297A2D39 + 11) & int(_CELLS)


#: Cells of texts by the bits of their number of terms.
_LENGTHS = _cell(tx.mix(np.arange(1, 33, dtype=np.uint64) << np.uint64(40)))


def document_cells(lines: np.ndarray, n_terms: int) -> np.ndarray:
    """Distinct cells of a document of ``n_terms`` terms: its terms, their beginnings, those of several terms or that
    occur often, and its length."""
    _, at, n = np.unique(lines[:, 0], return_index=True, return_counts=True)
    cells = _cell(lines)
    parts = [cells[at].ravel(), _often(cells[at[n >= OFTEN], 0]), _LENGTHS[min(31, int(n_terms).bit_length())][None]]
    for k in range(1, lines.shape[1]):
        head, n = np.unique(cells[:, k], return_counts=True)
        parts.append(_often(head[n >= OFTEN]))
        head, n = np.unique(cells[at, k], return_counts=True)
        parts.append(_twice(head[n > 1]))
    return np.unique(np.concatenate(parts))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for _, lines, first in term_hashes(batch.column("text")):
            rows += [document_cells(lines[a:b], b - a).astype(np.int32) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], names=["id", "toxic", "cells"])


def _sum_rows(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, values[:, f], n).astype(values.dtype) for f in range(values.shape[1])], 1)


@dataclass
class FactorizationMachine:
    """Sparse weights: ``slot`` maps a cell to a row of ``linear`` and ``factors``, or to -1."""

    slot: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def margins(self, slots: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        v = self.factors[slots]
        sums, squares = _sum_rows(v, row, n), _sum_rows(v * v, row, n)
        return self.bias + np.bincount(row, self.linear[slots], n) + 0.5 * (sums * sums - squares).sum(1)

    def scores(self, slots: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        a, b = self.scale
        return sigmoid(a * self.margins(slots, row, n) + b)


def _flat(cells: list[np.ndarray], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    slots = slot[np.concatenate([np.zeros(0, np.int64), *cells]).astype(np.int64)]
    return slots[slots >= 0], row[slots >= 0]


def strongest(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Places in the counts whose log odds are ``STRENGTH`` deviations from the mean."""
    odds = np.log((pos + 0.5) / (n_pos - pos + 0.5)) - np.log((neg + 0.5) / (n_neg - neg + 0.5))
    error = np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5) + 1 / (n_pos - pos + 0.5) + 1 / (n_neg - neg + 0.5))
    strength = np.where(pos + neg >= LEAST_ROWS, np.abs(odds) / error, 0.0)
    return np.flatnonzero(strength > STRENGTH)


def common(pos: np.ndarray, neg: np.ndarray, n_rows: float) -> np.ndarray:
    """Places of the ``PAIRED`` cells that most rows have, of those that one row in ten lacks."""
    n = pos + neg
    places = np.flatnonzero((n >= LEAST_ROWS) & (10 * n <= 9 * n_rows))
    return places[np.argsort(-n[places], kind="stable")[:PAIRED]]


def telling_pairs(cells: list[np.ndarray], labels: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Members of all pairs of cells ``among`` which are toxic more or less often than their members'
    odds, added, would have it."""
    slot = np.full(1 << HASH_BITS, -1, np.int32)
    slot[among] = np.arange(len(among))
    slots, row = _flat(cells, slot)
    logit = lambda p, n: np.log((p + 0.5) / (n - p + 0.5))
    base = logit(labels.sum(), len(labels))
    own = (logit(np.bincount(slots, labels[row], len(among)), np.bincount(slots, minlength=len(among))) - base).astype(np.float32)
    found = [among[:0]]
    for c in range(0, len(among), 256):  # a band of the matrix at a time
        both, toxic = np.zeros((2, len(among[c : c + 256]), len(among)), np.float32)
        for i in range(0, len(cells), 1024):
            lo, hi = np.searchsorted(row, (i, i + 1024))
            has = np.zeros((len(cells[i : i + 1024]), len(among)), np.float32)
            has[row[lo:hi] - i, slots[lo:hi]] = 1
            both += has[:, c : c + 256].T @ has
            toxic += (has[:, c : c + 256] * labels[i : i + 1024, None].astype(np.float32)).T @ has
        share = sigmoid(np.float32(base) + own[c : c + 256, None] + own[None, :])
        off = np.abs(toxic - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 0.5))
        off[(both < 4 * LEAST_ROWS) | (np.arange(len(among))[None, :] <= np.arange(c, c + len(both))[:, None])] = 0
        one, other = np.nonzero(off >= LEAST_DEVIATION)
        found += [among[one + c], among[other]]
    return np.unique(np.concatenate(found))


def choose(cells: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The cells for a model of rows at hand."""
    flat, row = np.concatenate([np.zeros(0, np.int64), *cells]), np.repeat(labels, [len(c) for c in cells])
    pos, neg = np.bincount(flat, row, 1 << HASH_BITS), np.bincount(flat, 1 - row, 1 << HASH_BITS)
    single = strongest(pos, neg, labels.sum(), (1 - labels).sum())
    return np.unique(np.concatenate([single, _LENGTHS, telling_pairs(cells, labels, common(pos, neg, len(labels)))]))


def fit(cells: list[np.ndarray], labels: np.ndarray, steps: int = 250, seed: int = 5, back: np.ndarray | None = None, chosen: np.ndarray | None = None) -> FactorizationMachine:
    """Adam on the mean log loss with weight decay. ``back`` marks the rows that are held back for calibration, one in
    five unless given; ``chosen`` are the cells that the model has, by default those that ``choose`` takes from the other rows."""
    n_cells = 1 << HASH_BITS
    labels = labels.astype(float)
    if not len(labels) or labels.min() == labels.max():  # nothing to tell apart
        share = (labels.sum() + 0.5) / (len(labels) + 1.0)
        bias = float(np.log(share / (1 - share)))
        return FactorizationMachine(np.full(n_cells, -1, np.int32), np.zeros(1), np.zeros((1, FACTORS)), bias)
    if back is None or labels[~back].min(initial=1) == labels[~back].max(initial=0) or not back.any():
        back = np.arange(len(labels)) % 5 == 0
    train = np.flatnonzero(~back)
    if chosen is None:
        chosen = choose([cells[i] for i in train], labels[train])
    n_pos, n_neg = max(labels[train].sum(), 0.5), max((1 - labels[train]).sum(), 0.5)
    slot = np.full(n_cells, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    rng = np.random.Generator(np.random.PCG64(seed))
    size = max(1, len(chosen))
    model = FactorizationMachine(slot, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32), float(np.log(n_pos / n_neg)))
    all_slots, all_rows = _flat([cells[i] for i in train], slot)
    y, n = labels[train], len(train)
    weight = np.where(y > 0, 0.5 / n_pos, 0.5 / n_neg)
    state = [np.zeros_like(x) for x in (model.linear, model.linear, model.factors, model.factors)]
    bias_state = [0.0, 0.0]
    for t in range(1, steps + 1):
        seen = rng.random(len(all_slots)) < SEEN
        slots, row = all_slots[seen], all_rows[seen]
        v = model.factors[slots]
        sums = _sum_rows(v, row, n)
        slope = weight * (sigmoid(model.margins(slots, row, n)) - y)
        at = slope[row].astype(np.float32)
        g_linear = np.bincount(slots, at, size) + 1e-5 * model.linear
        np.subtract(sums[row], v, out=v)
        v *= at[:, None]
        g_factors = _sum_rows(v, slots, size) + np.float32(1e-4) * model.factors
        for k, (value, grad) in enumerate(((model.linear, g_linear), (model.factors, g_factors))):
            m, s = state[2 * k], state[2 * k + 1]
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            value -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        g = slope.sum()
        bias_state = [bias_state[0] + 0.1 * (g - bias_state[0]), bias_state[1] + 0.01 * (g * g - bias_state[1])]
        model.bias -= 0.1 * (bias_state[0] / (1 - 0.9**t)) / (np.sqrt(bias_state[1] / (1 - 0.99**t)) + 1e-8)
    held = np.flatnonzero(back)
    model.scale = calibrate_at(model.margins(*_flat([cells[i] for i in held], slot), len(held)), labels[held], THRESHOLD)
    return model


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> FactorizationMachine:
    """Fit on at most ``max_positive`` toxic and ``max_negative`` other labelled rows that are not held out,
    chosen by a hash of their doc_id. A doc_id with several labels is toxic if one of them says so; of several rows of a
    doc_id one is used. Labels without a document, and null ids and labels, are left out."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("id"), "id"]
    chosen = usable.where("toxic = 1").orderBy(*order).limit(max_positive).unionByName(usable.where("toxic = 0").orderBy(*order).limit(max_negative))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # At most max_positive + max_negative rows of two numbers.
    sample = texts.join(F.broadcast(chosen), "id").select("id", "toxic", "text")
    rows = map_batches(sample, _cells, "id long, toxic int, cells array<int>").groupBy("id", "toxic").agg(F.min("cells").alias("cells"))
    rows = materialise(rows.withColumn("back", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0), "toxicity-sample")
    counts = rows.where("not back").select("toxic", F.explode("cells").alias("cell")).groupBy("cell").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    total = rows.where("not back").agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos"), F.count("*").alias("n")).first()
    seen = counts.orderBy("cell").toPandas()  # 2^HASH_BITS rows of three numbers at most
    pos, n, cells = seen["pos"].to_numpy(float), seen["n"].to_numpy(float), seen["cell"].to_numpy(np.int64)
    single = cells[strongest(pos, n - pos, total["pos"], total["n"] - total["pos"])]
    frequent = cells[common(pos, n - pos, total["n"])]
    wanted = np.unique(np.concatenate([single, frequent, _LENGTHS]))
    listed = F.split(F.lit(",".join(map(str, wanted))), ",").cast("array<int>")
    # The sampled rows, with the wanted cells only.
    found = rows.select("toxic", "back", F.array_intersect("cells", listed).alias("cells")).orderBy(F.xxhash64("id"), "id").toPandas()
    own, toxic, back = [np.asarray(c, np.int64) for c in found["cells"]], found["toxic"].to_numpy(), found["back"].to_numpy(bool)
    pairs = telling_pairs([c for c, held in zip(own, back, strict=True) if not held], toxic[~back], frequent) if len(frequent) else frequent
    return fit(own, toxic, back=back, chosen=np.unique(np.concatenate([single, pairs, _LENGTHS])))


def _score(model: FactorizationMachine, threshold: float):
    known, every = model.slot >= 0, np.arange(1 << HASH_BITS)
    known = known | known[_twice(every)] | known[_often(every)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for _, lines, first in term_hashes(batch.column("text")):
                n = len(first) - 1
                # Lines that lead to no cell of the model can be left out: a beginning counts or not as a whole.
                kept = np.flatnonzero(known[_cell(lines)].any(1))
                ends = np.searchsorted(kept, first)
                found = [document_cells(lines[kept[a:b]], m) for a, b, m in zip(ends[:-1], ends[1:], np.diff(first), strict=True)]
                parts.append(model.scores(*_flat(found, model.slot), n))
            scores = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text, ...)``.

    Null and empty texts get the score of a text without terms; very long ones are read whole. Repeated rows score alike; a
    null doc_id is passed through and counts as not held out; an empty table gives an empty result. A score that ties with
    the threshold is predicted toxic. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = map_batches(base, _score(model, threshold), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def _keep(model: FactorizationMachine, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["doc_id", "text"])
            for scored in _score(model, threshold)(iter([one])):
                yield batch.filter(pa.array(scored.column("predicted").to_numpy() == 0))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, whatever their names. Null and empty
    texts are scored as texts without terms, very long ones whole; a null or repeated doc_id makes no difference, repeated
    rows fare alike, and an empty table stays empty."""
    return map_batches(docs, _keep(train(docs, labels), threshold), docs.schema)
