"""Quality rules as a short-circuit cascade.

Every rule rejects a document by one integer comparison. Each rule's cost and selectivity are estimated on a
sample; rules then run in order of rejections per cost, and a document leaves the cascade at its first
rejection. The verdict is the conjunction of all rules, so the order changes the time taken and nothing else.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import text as tx
from scoreloom.llm.storage import map_batches

WINDOW = 8
#: Rows that are looked at before the order of the rules is set. The order never changes a verdict.
SAMPLE_ROWS = 4000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BYTE = np.arange(256)
_LEAD = (_BYTE & 0xC0) != 0x80
_UPPER = (_BYTE >= ord("A")) & (_BYTE <= ord("Z"))
_ASCII_LETTER = _UPPER | ((_BYTE >= ord("a")) & (_BYTE <= ord("z")))
_LETTER = _ASCII_LETTER | (_BYTE >= 0x80)
_BLANK = b" \t\n\x0b\x0c\r"


class Document:
    """One text; every measure is computed on first use only."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return tx.word_bounds(self.raw, np.array([0, len(self.raw)]))

    @cached_property
    def n_words(self) -> int:
        return len(self.bounds[0])

    @cached_property
    def words(self) -> np.ndarray:
        return tx.word_hashes(self.raw, np.array([0, len(self.raw)]), fold=False)[0]

    @cached_property
    def word_chars(self) -> int:
        return int(np.count_nonzero(_LEAD[self.raw] & ~tx.is_space(self.raw)))

    @cached_property
    def n_symbols(self) -> int:
        return int(np.count_nonzero(_SYMBOL[self.raw]))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.tobytes().split(b"\n") if x.strip(_BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        windows = tx.shingle_hashes(self.words, WINDOW)
        if len(windows) < 2:
            return 0
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return 0
        at = np.flatnonzero(np.isin(windows, twice))
        steps = np.zeros(self.n_words + 1, np.int64)
        steps[at] += 1
        np.subtract.at(steps, at + WINDOW, 1)
        return int(np.count_nonzero(np.cumsum(steps[:-1])))

    @cached_property
    def n_stutters(self) -> int:
        return int(np.count_nonzero(self.words[1:] == self.words[:-1]))

    @cached_property
    def n_letter_words(self) -> int:
        if not self.n_words:
            return 0
        total = np.concatenate(([0], np.cumsum(_LETTER[self.raw])))
        return int(np.count_nonzero(total[self.bounds[1]] > total[self.bounds[0]]))

    @cached_property
    def n_letters(self) -> int:
        return int(np.count_nonzero(_ASCII_LETTER[self.raw]))

    @cached_property
    def n_upper(self) -> int:
        return int(np.count_nonzero(_UPPER[self.raw]))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


#: The first two are the base rules. Thresholds are integers, so that any engine can repeat them.
RULES = (
    Rule("few_words", lambda d: d.n_words < 20),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 30 * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > 3 * d.n_words),
    Rule("word_length", lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 12 * d.n_words),
    Rule("duplicate_lines", lambda d: 10 * d.n_dup_lines > 4 * len(d.lines)),
    Rule("few_letters", lambda d: 10 * d.n_letter_words < 6 * d.n_words),
    Rule("upper_case", lambda d: 10 * d.n_upper > 4 * d.n_letters),
    Rule("stutter", lambda d: 10 * d.n_stutters > 2 * d.n_words),
)


def _documents(column: pa.Array) -> Iterator[Document]:
    data, offsets = tx.utf8(column)
    for i in range(len(offsets) - 1):
        yield Document(data[offsets[i] : offsets[i + 1]])


def _trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every rule alone on each row: seconds and rejections."""
    spent, rejected = [0.0] * len(RULES), [0] * len(RULES)
    for batch in batches:
        for document in _documents(batch.column("text")):
            for k, rule in enumerate(RULES):
                began = time.perf_counter()
                rejected[k] += rule.rejects(Document(document.raw))
                spent[k] += time.perf_counter() - began
    yield pa.RecordBatch.from_pydict({"rule": [r.name for r in RULES], "seconds": spent, "rejected": rejected})


def plan_cascade(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by descending rejections per second on about ``sample_rows`` rows, drawn at random over the whole table.
    Ties, and tables without rows, keep the order of ``RULES``."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    sample = texts.sample(min(1.0, sample_rows / max(1, docs.count())), seed=7)
    trial = map_batches(sample, _trial, "rule string, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
    rate = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in trial.collect()}  # a row for each rule
    return sorted((r.name for r in RULES), key=lambda name: -rate.get(name, 0.0))


def _apply(order: list[str]):
    by_name = {r.name: r for r in RULES}
    cascade = [by_name[name] for name in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = list(_documents(batch.column("text")))
            kept = [not any(rule.rejects(d) for rule in cascade) for d in docs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([getattr(d, name) for d in docs], pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    pa.array([RULES[0].rejects(d) or RULES[1].rejects(d) for d in docs], pa.bool_()),
                    pa.array(kept, pa.bool_()),
                ],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    return run


def _verdicts(order: list[str]):
    by_name = {r.name: r for r in RULES}
    cascade = [by_name[name] for name in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not any(rule.rejects(d) for rule in cascade) for d in _documents(batch.column("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def quality_filter(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; measures are computed only as far
    as the cascade goes. A null or empty text is rejected as having few words, a very long one is read whole; a null or
    repeated doc_id makes no difference, repeated rows fare alike, columns may have any names, and an empty table stays
    empty."""
    return map_batches(docs, _verdicts(order or plan_cascade(docs)), docs.schema)


def quality_report(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of every row.

    Null texts count as empty: all zeros, base_failed, not kept; very long ones are read whole. Repeated rows are measured
    alike; a null doc_id is passed through; a measure that ties with its limit is not rejected; an empty table gives an
    empty result; other columns are ignored."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(
        base,
        _apply(order or plan_cascade(docs)),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean",
    )
