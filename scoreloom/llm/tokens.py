"""Token counts of whole texts without materialising ids.

A text is cut into pre-tokens by the tokenizer's own normaliser and pre-tokenizer. Spark counts the pieces of each
distinct pre-token once, joins them to the documents' pre-token frequencies, and sums. For tokenizers that drop white space
(others are refused), no pre-token spans a space or a line end, and neither composition nor lower-casing acts across
one, so what lies between two of them is cut alike wherever it stands: a task keeps what it has cut already, in a table
of bounded size.

The pieces of the commonest pre-tokens, at most ``HEAD`` found in a sample of documents, go to the tasks as a table of fixed
size and are summed where the text is; they are the hot keys of the join. All other pre-tokens are joined in Spark. Which
is which makes no difference to a count.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.storage import map_batches, materialise

#: Pre-tokens whose pieces every task knows; the bytes of one; the documents they are sought in.
HEAD, HEAD_BYTES, HEAD_SAMPLE = 1 << 17, 48, 1 << 11
#: Stretches between spaces that a task remembers, and characters of the longest.
MEMO, MEMO_CHARS = 1 << 19, 48
#: Characters of a text that are cut at once, up to the next space.
PART = 1 << 20

_FREQUENCIES = "row long, doc_id long, n_bytes long, known long, rest array<string>, times array<long>"


@functools.lru_cache(maxsize=2)
def _tokenizer(definition: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


@functools.lru_cache(maxsize=2)
def _special(definition: str) -> re.Pattern | None:
    """The strings that are one token wherever they stand, longest first."""
    added = json.loads(definition).get("added_tokens") or []
    if any(t[k] for t in added for k in ("normalized", "single_word", "lstrip", "rstrip")) or any(" " in t["content"] for t in added):
        raise ValueError("special tokens that take in their surroundings, or hold spaces, are not supported")
    found = sorted((t["content"] for t in added), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


def _cutter(definition: str) -> Callable[[str], list[str]]:
    tokenizer = _tokenizer(definition)

    def pre_tokens(text: str) -> list[str]:
        if tokenizer.normalizer is not None:
            text = tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    return pre_tokens


def check(definition: str) -> None:
    """Raises ValueError for a tokenizer to which this way of counting doesn't apply."""
    _special(definition)
    if _tokenizer(definition).pre_tokenizer is None:
        raise ValueError("the tokenizer has no pre-tokens")
    cut, words = _cutter(definition), ("Ab", "c's", "\u0301d", "7.", "\u03a3")
    for blank in (" ", "\n"):
        if cut(blank.join(words)) != [p for w in words for p in cut(w)]:
            raise ValueError("the tokenizer's pre-tokens take in white space")


def _resolve(definition: str, stretches: list[str]) -> Iterator[tuple[str, int, list[str]]]:
    """Each stretch with its special tokens and its pre-tokens. Those without special tokens are cut in one call."""
    special, cut = _special(definition), _cutter(definition)
    plain = []
    for s in stretches:
        if special is not None and special.search(s):
            yield s, len(special.findall(s)), [p for part in special.split(s) if part for p in cut(part)]
        elif s:
            plain.append(s)
        else:
            yield s, 0, []
    tokenizer = _tokenizer(definition)
    joined = " ".join(plain)
    if tokenizer.normalizer is not None:
        joined = tokenizer.normalizer.normalize_str(joined)
    if joined.count(" ") != len(plain) - 1:  # other white space in them
        yield from ((s, 0, cut(s)) for s in plain)
        return
    found = iter(tokenizer.pre_tokenizer.pre_tokenize_str(joined))
    token, (_, end) = next(found, ("", (0, len(joined) + 2)))
    at = 0
    for s, normal in zip(plain, joined.split(" "), strict=True):
        at += len(normal) + 1
        mine = []
        while end < at:
            mine.append(token)
            token, (_, end) = next(found, ("", (0, len(joined) + 2)))
        yield s, 0, mine


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts that end at spaces."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _frequencies(definition: str, head: dict[str, int]):
    """For every row the tokens that are known here, and the other pre-tokens with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, tuple[str, ...]]] = {}

        def count(units: list[tuple[int, Counter]], known: list[int], other: list[Counter]) -> None:
            if len(memo) > MEMO:
                memo.clear()
            seen = memo
            new = {s for _, c in units for s in c if s not in memo}
            if new:
                seen = {}
                for s, n, found in _resolve(definition, list(new)):
                    what = n + sum(head.get(p, 0) for p in found), tuple(p for p in found if p not in head)
                    seen[s] = what
                    if len(s) <= MEMO_CHARS:
                        memo[s] = what
            for row, c in units:
                for s, n in c.items():
                    total, unknown = memo.get(s) or seen[s]
                    known[row] += n * total
                    for p in unknown:
                        other[row][p] += n

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                piece = batch.slice(at, 512)
                known, other = [0] * piece.num_rows, [Counter() for _ in range(piece.num_rows)]
                sizes, units, waiting = [], [], 0
                for row, text in enumerate(texts[at : at + 512]):
                    text = text or ""
                    sizes.append(len(text.encode()))
                    for part in parts(text.replace("\n", " ")):
                        units.append((row, Counter(part.split(" "))))
                        waiting += len(part)
                        if waiting > PART:
                            count(units, known, other)
                            units, waiting = [], 0
                count(units, known, other)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row"), piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()),
                     pa.array([list(c) for c in other], pa.list_(pa.string())), pa.array([list(c.values()) for c in other], pa.list_(pa.int64()))],
                    names=[x.split()[0] for x in _FREQUENCIES.split(", ")],
                )

    return run


def _pieces(definition: str):
    """The number of pieces of each pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(definition).model
        for batch in batches:
            counts = [len(model.tokenize(p)) for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(counts, pa.int64())], names=["piece", "n_pieces"])

    return run


def _head(base: DataFrame, definition: str, size: int, sample: int) -> dict[str, int]:
    """Pieces of the pre-tokens that most of about ``sample`` documents have; at most ``size``."""
    if size <= 0 or sample <= 0:
        return {}
    # By a hash of each row's number, where the row is: what is sampled is no larger for a larger table, and passes through no one task.
    share = min(1.0, sample / max(base.count(), 1))
    few = base.where(F.xxhash64("row") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))))
    found = map_batches(few, _frequencies(definition, {}), _FREQUENCIES).select(F.explode("rest").alias("piece"))
    common = found.where(F.octet_length("piece") <= HEAD_BYTES).groupBy("piece").count().orderBy(F.desc("count"), "piece").limit(size)
    return {r["piece"]: r["n_pieces"] for r in map_batches(common.select("piece"), _pieces(definition), "piece string, n_pieces long").toLocalIterator()}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, head: int = HEAD, sample: int = HEAD_SAMPLE) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs(doc_id, text, ...)``.

    ``tokenizer`` is the path of a definition file of the ``tokenizers`` library, read on the driver. Counts are those of
    ``encode(text, add_special_tokens=False)``: special strings inside a text are one token each, nothing is cut off or
    padded. ``over_limit``: more than ``limit`` tokens.

    Null texts are empty and have no tokens. Rows with null doc_ids and repeated rows are counted one by one. Very long texts are
    cut part by part. Ties make no difference. An empty table gives an empty result. Other columns are ignored, whatever
    their names.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    check(definition)
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = _head(base, definition, head, sample)
    counted = materialise(map_batches(base, _frequencies(definition, known), _FREQUENCIES), "frequencies")
    rest = counted.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("piece"), F.col("x.times").alias("times"))
    # Written, so that the join can split a pre-token that many documents have.
    pieces = materialise(map_batches(rest.select("piece").distinct(), _pieces(definition), "piece string, n_pieces long"), "pieces")
    sums = rest.join(pieces, "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("n_pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    result = counted.select("row", "doc_id", "n_bytes", "known").join(sums, "row", "left")
    return result.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
