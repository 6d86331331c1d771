"""Benchmark decontamination by SimHash of item-sized windows.

For an item of L words, every window of L words of a document is a possible copy; a document of fewer words
is one window as a whole, kept under L but with its own shingles. Windows and items are compared by weighted five-word
shingles; a shingle's weight is how often it occurs. An item of fewer than five words is a single shingle, and so are the
windows of its length: they match when they are equal. A window can only
reach the threshold if shingles of items of L words make up at least that share of its weight, which one pass
over the text decides exactly; the surviving windows get 64-bit SimHash fingerprints. Fingerprints are
cut into RADIUS + 1 blocks: two within RADIUS bits agree in a block, so an equality join on
(length, block number, block bits) finds all of them. Those within the radius are decided by
exact weighted-shingle similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import text as tx
from scoreloom.llm.keyfilter import by_text, text_key
from scoreloom.llm.storage import map_batches, materialise

SHINGLE = 5
PERCENT = 80
#: At a similarity of 0.8 two fingerprints differ in 9.7 bits on average, with a deviation of 2.9.
RADIUS = 21
BITS = 64
#: About how many shingles of items are sent to the tasks at once (16 bytes each); a larger benchmark is searched in
#: several passes. An item is never cut.
SHINGLES_PER_PASS = 1 << 20
#: Windows that a task hands on at a time.
ROWS = 1024

_EDGES = np.linspace(0, BITS, RADIUS + 2).round().astype(int)


def simhash(shingles: np.ndarray) -> int:
    """Sign of each bit's vote over a window's shingles; a repeated shingle votes as often as it occurs."""
    bits = np.unpackbits(tx.mix(shingles ^ np.uint64(0x5DEECE66D)).view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(shingles)).view(np.uint64)[0])


def blocks(prints: np.ndarray) -> np.ndarray:
    """The RADIUS + 1 block values of each 64-bit fingerprint."""
    parts = []
    for lo, hi in zip(_EDGES[:-1], _EDGES[1:], strict=True):
        parts.append((prints >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1))
    return np.stack(parts, 1).astype(np.int32)


def weighted_overlap(left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
    """Weights of the intersection and the union of two shingle bags."""
    a, na = np.unique(left, return_counts=True)
    b, nb = np.unique(right, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = int(np.minimum(na[i], nb[j]).sum())
    return common, len(left) + len(right) - common


_PRINTED = "id string, at long, n_words long, print long, content long, parts array<int>, bag binary"


def _printed(rows: list[tuple[str, int, int, np.ndarray]]) -> pa.RecordBatch:
    prints = np.array([simhash(r[3]) for r in rows], np.uint64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array(prints.view(np.int64)),
            pa.array([xxhash.xxh3_64_intdigest(r[3].tobytes()) - (1 << 63) for r in rows], pa.int64()),
            pa.array(list(blocks(prints)) if rows else [], pa.list_(pa.int32())),
            pa.array([r[3].tobytes() for r in rows], pa.binary()),
        ],
        names=["id", "at", "n_words", "print", "content", "parts", "bag"],
    )


def item_shingles(words: np.ndarray) -> np.ndarray:
    """All shingles, in order; with fewer than ``SHINGLE`` words, the whole sequence as one."""
    return tx.shingle_hashes(words, SHINGLE) if len(words) >= SHINGLE else tx.document_shingles(words, SHINGLE)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.utf8(batch.column("text"))
        words, first = tx.word_hashes(data, offsets)
        rows = []
        for d, item in enumerate(batch.column("id").to_pylist()):
            own = words[first[d] : first[d + 1]]
            if item is not None and len(own):
                rows.append((item, 0, len(own), item_shingles(own)))
        yield _printed(rows)


def windows_of(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """First shingles of the windows of ``n`` words, in a document of ``length`` shingles, of which the known ones, ``at`` these
    places in order, have the needed share."""
    span = n - SHINGLE + 1
    low, high = max(0, int(at[0]) - span + 1), min(int(at[-1]), length - span)
    if high < low:
        return np.zeros(0, np.int64)
    known = np.zeros(high - low + span + 1, np.int64)
    known[at[(at >= low) & (at < high + span)] - low + 1] = 1
    total = np.cumsum(known)
    return low + np.flatnonzero(100 * (total[span:] - total[:-span]) >= PERCENT * span)


def short_enough(common: int, length: int, n: int) -> bool:
    """Whether a whole document of ``length`` shingles and fewer than ``n`` words can reach the threshold against an item of
    ``n`` words, if it shares ``common`` of them."""
    span = n - SHINGLE + 1
    return length < span and 100 * common >= PERCENT * (length + span - common)


def known_places(found: np.ndarray, first: np.ndarray, shingles: np.ndarray, lengths: np.ndarray, spots: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, length of items, places) of the ``found`` shingles at ``spots`` that are shingles of items, where there are
    enough of them for a copy."""
    low, high = np.searchsorted(shingles, found[spots], "left"), np.searchsorted(shingles, found[spots], "right")
    doc = np.searchsorted(first, spots, "right") - 1
    inside = (high > low) & (spots + SHINGLE <= first[doc + 1])  # else it runs into the next document
    spots, doc, low, n = spots[inside], doc[inside], low[inside], (high - low)[inside]
    if not len(spots):
        return
    at = np.repeat(spots - first[doc], n)
    of = lengths[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    doc = np.repeat(doc, n)
    order = np.lexsort((at, of, doc))
    at, of, doc = at[order], of[order], doc[order]
    edges = np.flatnonzero((doc[1:] != doc[:-1]) | (of[1:] != of[:-1])) + 1
    begin, end = np.concatenate(([0], edges)), np.append(edges, len(doc))
    for k in np.flatnonzero(100 * (end - begin) >= PERCENT * (of[begin] - SHINGLE + 1)):
        yield int(doc[begin[k]]), int(of[begin[k]]), at[begin[k] : end[k]]


def _windows(shingles: np.ndarray, lengths: np.ndarray):
    """``shingles``, sorted, and the ``lengths`` of the items they come from; a shingle of items of several lengths is
    there several times."""
    mask = np.uint64((1 << 22) - 1)
    short = lengths < SHINGLE
    whole = {int(n): np.sort(shingles[lengths == n]) for n in np.unique(lengths[short])}
    shingles, lengths = shingles[~short], lengths[~short]
    table = np.zeros(1 << 22, bool)  # a first look; hits are confirmed in the sorted list
    table[(shingles & mask).astype(np.int64)] = True

    def copies(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(document, first word, length of items, shingles) of each window that may be a copy."""
        found = tx.shingle_hashes(words, SHINGLE)
        for d, n, at in known_places(found, first, shingles, lengths, np.flatnonzero(table[(found & mask).astype(np.int64)])):
            lo, length = first[d], first[d + 1] - first[d] - SHINGLE + 1
            if short_enough(len(at), length, n):
                yield d, 0, n, found[lo : lo + length]
            for start in windows_of(at, length, n):
                yield d, int(start), n, found[lo + start : lo + start + n - SHINGLE + 1]
        for n, known in whole.items():
            runs = tx.shingle_hashes(words, n) ^ np.uint64(n)
            place = np.minimum(np.searchsorted(known, runs), len(known) - 1)
            spots = np.flatnonzero(known[place] == runs)
            doc = np.searchsorted(first, spots, "right") - 1
            for at, d in zip(spots, doc, strict=True):
                if at + n <= first[d + 1]:
                    yield int(d), int(at - first[d]), n, runs[at : at + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.utf8(batch.column("text"))
            ids, rows = batch.column("id").to_pylist(), []
            for i, j in tx.slices(offsets):
                words, first = tx.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for d, at, n, bag in copies(words, first):
                    rows.append((ids[i + d], at, n, bag))
                    if len(rows) >= ROWS:
                        yield _printed(rows)
                        rows = []
            yield _printed(rows)

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok, share = [], []
        for x, y in zip(batch.column("bag").to_pylist(), batch.column("item_bag").to_pylist(), strict=True):
            common, union = weighted_overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
            ok.append(100 * common >= PERCENT * union)
            share.append(common / union)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("n_words", "print", "content", "item")), pa.array(share, pa.float64())], names=["n_words", "print", "content", "item", "similarity"]).filter(pa.array(ok, pa.bool_()))


def _matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(id, item, at, n_words, similarity)`` of ``docs(id, text)`` and printed items, of about ``SHINGLES_PER_PASS`` shingles."""
    # At most about SHINGLES_PER_PASS rows of two numbers, whatever the benchmark's size.
    rows = items.select("n_words", "bag").distinct().collect()
    bags = [np.unique(np.frombuffer(r["bag"], np.uint64)) for r in rows]
    pairs = np.unique(np.stack([np.concatenate(bags), np.repeat([r["n_words"] for r in rows], [len(b) for b in bags]).astype(np.uint64)], 1), axis=0)
    windows = materialise(map_batches(docs, _windows(pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)), _PRINTED), "windows")
    # Copies of a passage make the same windows in many documents: each content is compared once.
    name = ["n_words", "print", "content"]
    contents = windows.groupBy(*name).agg(F.first("bag").alias("bag"), F.first("parts").alias("parts"))
    keyed = contents.select(*name, "bag", F.posexplode("parts").alias("b", "v"))
    target = items.select(F.col("id").alias("item"), "n_words", F.col("print").alias("q"), F.col("bag").alias("item_bag"), F.posexplode("parts").alias("b", "v"))
    close = keyed.join(target, ["n_words", "b", "v"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("q"))) <= RADIUS)
    # A pair may agree in several blocks and counts once.
    near = close.groupBy(*name, "item").agg(F.first("bag").alias("bag"), F.first("item_bag").alias("item_bag"))
    similar = map_batches(near, _similar, "n_words long, print long, content long, item string, similarity double")
    # A bag has 8 bytes a shingle; a document shorter than the item has fewer words than the item.
    own = F.when(F.col("n_words") < SHINGLE, F.col("n_words")).otherwise((F.octet_length("bag") / 8 + SHINGLE - 1).cast("long")).alias("own")
    places = windows.select("id", "at", *name, own).distinct()
    return places.join(similar, name).select("id", "item", "at", F.col("own").alias("n_words"), "similarity")


def _copies(docs: DataFrame, benchmark: DataFrame, shingles_per_pass: int) -> DataFrame:
    named = benchmark.select(F.col("item_id").cast("long").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    items = materialise(map_batches(named, _items, _PRINTED).distinct(), "items")
    total = items.agg(F.sum(F.octet_length("bag") / 8)).first()[0] or 0
    passes = max(1, -int(-total // shingles_per_pass))
    parts = [items.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k) for k in range(passes)]
    found = [_matches(docs, part) for part in parts if not part.isEmpty()]
    if not found:
        return docs.sparkSession.createDataFrame([], "id string, item string, at long, n_words long, similarity double")
    return reduce(DataFrame.unionByName, found)


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, shingles_per_pass: int = SHINGLES_PER_PASS) -> DataFrame:
    """``(doc_id, item_id, at, n_words, similarity)``: every window of a document, from word ``at`` (0-based),
    that is a copy of a benchmark item. A document shorter than the item is a single window of all its words.

    Null and blank texts hold no window; very long ones are read whole. Items of fewer than five words match equal windows only;
    those without a word match nothing. A null doc_id or item_id matches nothing. Repeated rows and items give the same
    windows once; texts that share a doc_id give the windows of all of them. Windows that tie are all listed. Empty tables
    give an empty result. Other columns are ignored.
    """
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    found = _copies(base, benchmark, shingles_per_pass)
    return found.select(F.col("id").cast("long").alias("doc_id"), F.col("item").cast("long").alias("item_id"), "at", "n_words", "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_windows, similarity)``: the documents that hold a copy of an item, with the best
    similarity of its windows. Documents without any are not listed; for nulls, repeats and the like see
    ``contaminated_windows``."""
    windows = contaminated_windows(docs, benchmark)
    return windows.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.max("similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shingles_per_pass: int = SHINGLES_PER_PASS) -> DataFrame:
    """The rows of ``docs`` whose text holds no copy of a benchmark item, with all their columns. A null or repeated doc_id makes
    no difference, nor do the names of other columns; null and blank texts stay, very long ones are read whole, repeated
    rows fare alike; an empty table or benchmark drops nothing."""
    base = docs.select(text_key(F.col("text")).alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    bad = materialise(_copies(base, benchmark, shingles_per_pass).select("id").distinct(), "contaminated")
    kept, rest = by_text(docs, bad, "id", "left_anti")
    return rest.unionByName(kept)
