"""JSON files that are one map from id to record, of any size, read in parallel.

A file is cut into byte ranges. A range can't know whether it begins inside a text, so a first job finds for each range what it does
to either state: whether its quotes are odd in number, and how deep it goes under each assumption. The driver puts these
together, a row a range, and then every range knows the state that it begins in. A second job reads the entries that
begin in its range, each to its end, block by block. An entry begins behind the map's brace or a comma at its level.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.scratch import materialise
from scoreloom.sources.files import store

RANGE, BLOCK = 32 << 20, 2 << 20
_QUOTE, _BACK, _COMMA, _OPEN, _CLOSE = b'"\\,{}'
_STEP = np.zeros(256, np.int8)
_STEP[[*b"{["]], _STEP[[*b"}]"]] = 1, -1
_BLANK = b" \t\r\n"
_BOM = b"\xef\xbb\xbf"


_EFFECTS = "path string, begin long, end long, odd boolean, depth0 int, depth1 int, some0 boolean, some1 boolean"
_STARTS = "path string, begin long, end long, inside boolean, depth int, closed boolean"


@dataclass
class State:
    """Where a scan stands: behind an escaping backslash, inside a text, and how deep in brackets."""

    escaped: bool = False
    inside: bool = False
    depth: int = 0


def _outside(block: np.ndarray, state: State) -> tuple[np.ndarray, State]:
    """Which bytes of a block stand outside of texts, quotes not among them, and the state behind it (the depth is not looked at)."""
    back = np.flatnonzero(block == _BACK)
    escaped = np.zeros(len(block) + 1, bool)
    escaped[0] = state.escaped
    if len(back):
        first = back[np.concatenate(([True], back[1:] != back[:-1] + 1))]
        last = back[np.concatenate((back[1:] != back[:-1] + 1, [True]))]
        run = last - first + 1
        if state.escaped and first[0] == 0:
            run[0] -= 1  # the first one is itself escaped
        escaped[last + 1] |= run % 2 == 1
    quote = (block == _QUOTE) & ~escaped[:-1]
    odd = (np.cumsum(quote, dtype=np.int32) + state.inside) % 2 == 1
    return ~odd & ~quote, State(bool(escaped[-1]), bool(odd[-1]) if len(block) else state.inside, state.depth)


class _File:
    """Bytes of a file, block by block, from any place."""

    def __init__(self, uri: str):
        system, path = store(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def blocks(self, at: int, end: int) -> Iterator[tuple[int, bytes]]:
        while at < end:
            self.file.seek(at)
            block = self.file.read(min(BLOCK, end - at))
            if not block:
                return
            yield at, block
            at += len(block)

    def escaped(self, at: int) -> bool:
        """Whether an odd number of backslashes stands right before a place."""
        n = 0
        while at > 0:
            begin = max(0, at - 4096)
            self.file.seek(begin)
            block = self.file.read(at - begin)
            tail = len(block) - len(block.rstrip(b"\\"))
            n += tail
            if tail < len(block):
                break
            at = begin
        return n % 2 == 1


def _effects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each range does to a scan that begins outside of texts, and to one that begins inside."""
    for f in frames:
        rows = []
        for path, begin, end in zip(f["path"], f["begin"], f["end"], strict=True):
            file, depth, some, states = _File(path), [0, 0], [False, False], [State(), State(inside=True)]
            states[0].escaped = states[1].escaped = file.escaped(begin)
            for _, raw in file.blocks(begin, end):
                block = np.frombuffer(raw, np.uint8)
                step = _STEP[block]
                for k in (0, 1):
                    out, states[k] = _outside(block, states[k])
                    depth[k] += int(step[out].sum())
                    some[k] |= bool(step[out].any())
            rows.append((path, begin, end, states[0].inside, *depth, *some))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _EFFECTS.split(", ")])


def entries_from(file: _File, begin: int, end: int, inside: bool, depth: int, closed: bool = False) -> Iterator[bytes | None]:
    """The entries whose first byte's mark lies in a range that begins in the given state; None for what no map has there."""
    state, entry, level_now = State(file.escaped(begin), inside, depth), None, depth
    for at, raw in file.blocks(begin, file.size):
        block = np.frombuffer(raw, np.uint8)
        out, after = _outside(block, state)
        step = np.where(out, _STEP[block], 0)
        level = state.depth + np.cumsum(step, dtype=np.int32)
        marks = np.flatnonzero(out & (((block == _COMMA) & (level == 1)) | ((step == 1) & (level == 1)) | ((step == -1) & (level == 0))))
        place = 0

        def beside(upto: int) -> bool:
            """Whether something stands outside of the map."""
            return level_now == 0 and bool(raw[place:upto].removeprefix(_BOM[at + place :][: upto - place]).strip(_BLANK))  # noqa: B023

        for m in map(int, marks):
            if entry is not None:
                entry.append(raw[place:m])
                yield b"".join(entry)
                entry = None
            elif beside(min(m, max(place, end - at))) or (step[m] == 1 and at + m < end and (closed or block[m] != _OPEN)):
                yield None
            if at + m >= end:
                return
            place, level_now = m + 1, int(level[m])
            closed = closed or level_now == 0
            if level_now == 1:
                entry = []
        if entry is not None:
            entry.append(raw[place:])
        else:
            if beside(max(place, min(len(raw), end - at))):
                yield None
            if at + len(raw) >= end:
                return
        state = State(after.escaped, after.inside, int(level[-1]))
    if entry is not None:
        yield None  # the map isn't closed


_DECODER = json.JSONDecoder()


def _pair(entry: bytes) -> tuple[str, str] | None:
    """Key and value's text of an entry, or None where it is no JSON."""
    try:
        text = entry.decode("utf-8").strip(" \t\r\n")
        key, at = _DECODER.raw_decode(text)
        rest = text[at:].lstrip(" \t\r\n")
        if not isinstance(key, str) or not rest.startswith(":"):
            return None
        value = rest[1:].strip(" \t\r\n")
        json.loads(value)
    except ValueError:
        return None
    return key, value


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path, *range_ in zip(*(f[x.split()[0]] for x in _STARTS.split(", ")), strict=True):
            rows, waiting = [], 0
            for entry in entries_from(_File(path), *range_):
                if entry is not None and not entry.strip(_BLANK):
                    rows.append((path, None, ""))  # an empty map, or a comma too many
                    continue
                pair = None if entry is None else _pair(entry)
                rows.append((path, *pair) if pair else (path, None, None))
                waiting += len(entry or b"")
                if waiting > BLOCK:
                    yield pd.DataFrame(rows, columns=["path", "key", "value"])
                    rows, waiting = [], 0
            yield pd.DataFrame(rows, columns=["path", "key", "value"])


def begin_states(effects: Iterator) -> Iterator[tuple]:
    """The state that each range begins in, from what the ranges before it do; ranges of files that don't end outside of everything are left out. The
    effects come in the order of the file."""
    mine: list[tuple] = []
    inside, depth, closed = False, 0, False

    def ended() -> list[tuple]:
        return mine if depth == 0 and not inside else []

    for r in effects:
        if not mine or mine[-1][0] != r["path"]:
            yield from ended()
            mine, inside, depth, closed = [], False, 0, False
        mine.append((r["path"], r["begin"], r["end"], inside, depth, closed))
        depth += r["depth1"] if inside else r["depth0"]
        closed = closed or (depth == 0 and (r["some1"] if inside else r["some0"]))
        inside ^= r["odd"]
    yield from ended()


def read_json_map(spark: SparkSession, path: str, value: str, key: str = "case_id", size: int = RANGE) -> DataFrame:
    """The entries of JSON maps as rows of ``key`` and the fields of ``value``, a struct type in DDL. ``path`` is a file, a folder or a
    pattern. A file that isn't one whole map has no rows; an empty map has none either. Keys that a map repeats are rows each. A field
    of another type than asked for is null. Large files are read by ranges of ``size`` bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size).cast("long"))
    ranges = files.select("path", "length", F.explode(steps).alias("k")).select("path", (F.col("k") * size).alias("begin"), F.least((F.col("k") + 1) * size, F.col("length")).alias("end"))
    ranges = materialise(ranges, "ranges")
    dealt = ranges.repartition(max(1, min(ranges.count(), 4096)))
    effects = materialise(dealt.mapInPandas(_effects, _EFFECTS), "effects")
    begun = list(begin_states(effects.orderBy("path", "begin").toLocalIterator()))  # a row of numbers for each range, however long it is
    starts = spark.createDataFrame(begun, _STARTS).repartition(max(1, min(len(begun), 4096)))
    found = materialise(starts.mapInPandas(_records, "path string, key string, value string"), "records")
    wrong = found.where("key is null").groupBy("path").agg(F.count("*").alias("n"), F.count("value").alias("blank"))
    entries = found.where("key is not null")
    sizes = entries.groupBy("path").agg(F.count("*").alias("entries"))
    # One blank entry is an empty map if there are no others.
    bad = wrong.join(sizes, "path", "left").where("not (n = 1 and blank = 1 and entries is null)").select("path")
    good = entries.join(materialise(bad, "broken"), "path", "left_anti")
    return good.select(F.col("key").alias(key), F.from_json("value", value, {"mode": "PERMISSIVE"}).alias("r")).select(key, "r.*")
