"""Structure repair of conversations by dynamic programming shared along a prefix trie.

A conversation's rows, in order, become a signature of one letter each: ``x`` for a row that has to go (blank, or a duplicate
of an earlier one), else ``u``, ``a``, ``s`` or ``o`` by its role's initial, as a capital for a truncated text. The cheapest
edits depend on the signature alone. Spark sorts the distinct signatures; each task inserts its run of them into a
prefix trie, of which only the path to the current signature is held: what a signature shares with the one before is
kept, the rest is popped, and a layer is computed once for each new node. The answer is emitted at a terminal node.

A layer says, for each state of the roles so far (nothing, ``s``, ends in ``u``, ends in ``a``), the least cost of edits that
lead there and the order of the least such edits as texts. Edits of different states that end at the same row never begin one
another, so their order decides every later tie. Costs count from the layer's least; a state that costs over ``SLACK``
more can't lead to a cheapest answer and is left out. So there are few different layers, whatever the length, and each is
worked out once a task. For a node the trie holds the number of its layer, for the way back, and its cost.

Edits are written as ``K`` keep, ``R`` rerole, ``D`` delete and ``I`` insert. They tell the repaired roles: only a
kept row can be anything but user and assistant in turn.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.keyfilter import key_bitmap, split
from scoreloom.llm.storage import map_batches, materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: From any state at most two inserts lead to an end in ``a``, which does whatever any other state can at the cost of a delete more.
SLACK = 2 * INSERT + DELETE
NOTHING, S, U, A = range(4)
_NAMES = {U: "user", A: "assistant"}
_LONGEST = (1 << 63) - 1

_BLANKS = " \t\n\x0b\x0c\r"
_SIGNED = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"
_AUDITED = "signature string, cost long, audit string"
_REPAIRED = "conv_id long, repaired_sha256 string"

#: A layer: for each state (cost above the least, place among the states' edits), or None.
Layer = tuple[tuple[int, int] | None, ...]


def _inserted(state: int) -> Iterator[tuple[int, str]]:
    """The states that up to two inserts lead to, and those edits."""
    yield state, ""
    if state == U:
        yield A, "I"
        yield U, "II"
    else:
        yield U, "I"
        yield A, "II"


def _steps(state: int, letter: str) -> Iterator[tuple[int, int, str]]:
    """What may be done with a row from a state: the next state, the cost, the edit."""
    yield state, DELETE, "D"
    if letter == "x":
        return
    extra, role = (TRUNCATED if letter.isupper() else 0), letter.lower()
    turn = A if state == U else U
    yield turn, REROLE + extra, "R"
    if (role == "u" and turn == U) or (role == "a" and turn == A):
        yield turn, KEEP + extra, "K"
    if role == "s" and state == NOTHING:
        yield S, KEEP + extra, "K"


class _Layers:
    """Numbers the different layers, and knows what each letter makes of each: the next layer, the growth of the least cost, and
    for each state the state before and the edits."""

    def __init__(self):
        first: Layer = ((0, 0), None, None, None)
        self.layers, self.number, self.known = [first], {first: 0}, {}

    def after(self, number: int, letter: str) -> tuple[int, int, tuple[tuple[int, str] | None, ...]]:
        found = self.known.get((number, letter))
        if found is None:
            found = self.known[number, letter] = self._work_out(self.layers[number], letter)
        return found

    def _work_out(self, layer: Layer, letter: str):
        best: list[tuple[int, int, str, int] | None] = [None] * 4
        for before, held in enumerate(layer):
            if held is None:
                continue
            for state, inserts in _inserted(before):
                for end, cost, edit in _steps(state, letter):
                    one = held[0] + INSERT * len(inserts) + cost, held[1], inserts + edit, before
                    if best[end] is None or one < best[end]:
                        best[end] = one
        least = min(b[0] for b in best if b)
        best = [b if b and b[0] - least <= SLACK else None for b in best]
        order = sorted(b[1:3] for b in best if b)
        made: Layer = tuple(b and (b[0] - least, order.index(b[1:3])) for b in best)
        if made not in self.number:
            self.number[made] = len(self.layers)
            self.layers.append(made)
        return self.number[made], least, tuple(b and (b[3], b[2]) for b in best)

    def end(self, number: int) -> tuple[int, int, str]:
        """The cheapest way to a whole conversation: its cost above the least, the state it comes from, the inserts."""
        ends = {NOTHING: "", S: "II", U: "I", A: ""}
        options = [(held[0] + INSERT * len(ends[state]), held[1], state) for state, held in enumerate(self.layers[number]) if held]
        cost, _, state = min(options)
        return cost, state, ends[state]


class Trie:
    """The path from the root to the signature inserted last. Signatures come sorted."""

    def __init__(self):
        self.layers, self.path = _Layers(), ""
        self.numbers, self.costs = array("q", [0]), array("q", [0])
        self.made = 0

    def insert(self, signature: str) -> tuple[int, str]:
        """The least cost of a signature, and of the edits that cost it the first by ASCII."""
        low, high = 0, min(len(signature), len(self.path))
        while low < high:  # the length of the common prefix
            middle = (low + high + 1) // 2
            low, high = (middle, high) if signature[low:middle] == self.path[low:middle] else (low, middle - 1)
        del self.numbers[low + 1 :], self.costs[low + 1 :]
        for letter in signature[low:]:
            number, grown, _ = self.layers.after(self.numbers[-1], letter)
            self.numbers.append(number)
            self.costs.append(self.costs[-1] + grown)
            self.made += 1
        self.path = signature
        cost, state, last = self.layers.end(self.numbers[-1])
        edits = [last]
        for number, letter in zip(reversed(self.numbers[:-1]), reversed(signature)):
            state, edit = self.layers.after(number, letter)[2][state]
            edits.append(edit)
        return self.costs[-1] + cost, "".join(reversed(edits))


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        found = [trie.insert(s) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])


def cheapest_edits(signatures: DataFrame) -> DataFrame:
    """``(signature, cost, audit)`` of the distinct ``signatures(signature)``. Nulls are left out, the empty one costs nothing. One
    task holds a range of the sorted signatures and about 16 bytes for each letter of the one in hand."""
    distinct = signatures.where("signature is not null").select("signature").distinct()
    written = materialise(distinct, "signatures")
    ordered = written.repartitionByRange("signature").sortWithinPartitions("signature")
    return map_batches(ordered, _audit, _AUDITED)


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: rows damaged by crc32 of ``conv_id:turn`` modulo 20 (0 drops the row, 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role user). A dropped row stays with no copies, so that its
    conversation is not forgotten. Null roles and texts are one space, and so are null numbers in what is hashed."""
    space = F.lit(" ")
    row = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    return row.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _present(turn: str = "turn") -> Column:
    """Sorts as the turn does with nulls first, and is never null."""
    return F.struct(F.col(turn).isNotNull().alias("has"), F.coalesce(F.col(turn), F.lit(0)).alias("turn"))


def _faulty(rows: DataFrame) -> DataFrame:
    """Adds ``letter`` and ``fresh``: whether no earlier row of the conversation has this role and text. Equal rows of a turn become one with
    their copies. Only rows whose role and text may occur twice are shuffled for it."""
    said = F.rtrim("text", F.lit(_BLANKS))
    last = F.substring(said, -1, 1)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("u", "a", "s"), initial).otherwise("o")
    letter = F.when(said == "", "x").when(last.isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    here = rows.where("copies > 0").withColumns({"letter": letter, "initial": initial, "what": F.xxhash64("conv_id", "role", "text")})
    twice = materialise(here.where("letter <> 'x'").groupBy("what").agg(F.count("*").alias("n")).where("n > 1").select("what"), "said-twice")
    maybe, once = split(here, "what", key_bitmap(twice, "what"))
    same = ["conv_id", "role", "text"]
    merged = maybe.groupBy("turn", *same).agg(F.sum("copies").alias("copies"), F.first("letter").alias("letter"), F.first("initial").alias("initial"))
    merged = materialise(merged, "maybe-twice")  # written, as the next, so that the join can split what is said often
    firsts = materialise(merged.groupBy(*same).agg(F.min(_present()).alias("first")), "first-said")
    firsts = firsts.select("first", *(F.col(c).alias(f"{c}_") for c in same))
    joined = merged.join(firsts, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("role") == F.col("role_")) & (F.col("text") == F.col("text_")))
    columns = ["conv_id", "turn", "role", "text", "copies", "letter", "initial"]
    found = joined.select(*columns, (_present() == F.col("first")).alias("fresh")).unionByName(once.select(*columns, F.lit(True).alias("fresh")))
    dropped = rows.where("copies = 0").select("conv_id", F.lit(None).cast("long").alias("turn"), *(F.lit("").alias(c) for c in ("role", "text")), F.lit(0).cast("long").alias("copies"), F.lit("x").alias("letter"), F.lit("").alias("initial"), F.lit(True).alias("fresh"))
    ties = F.xxhash64("text").alias("tie"), F.xxhash64(F.lit(1), "text").alias("tie_")
    return found.unionByName(dropped).select("*", *ties)


def _in_order(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *more, F.col("turn").asc_nulls_first(), "role", "tie", "tie_")


class _Signature:
    """One conversation, fed with its rows in order."""

    def __init__(self, conv):
        self.conv, self.letters, self.last = conv, [], None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def feed(self, turn: int | None, copies: int, letter: str, initial: str, fresh: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.turns += 1
            self.high = turn
            self.low = turn if self.low is None else self.low
        kept = 1 if fresh and letter != "x" else 0
        self.letters.append((letter if kept else "") + "x" * (copies - kept))
        if letter == "x":
            self.blank += copies
        else:
            self.duplicate += copies - kept
            self.truncated += kept and letter.isupper()
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += (copies - 1) * (initial + initial not in ("su", "ua", "au"))
        self.last = initial

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, _LONGEST)
        return self.conv, "".join(self.letters), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _by_conversation(make, ddl: str):
    """Feeds each conversation's rows, which come one after another, to a new ``make(conv_id)``, and gives out its ``row()``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, out, waiting = None, [], 0
        for batch in batches:
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if one is None or one.conv != conv:
                    if one is not None:
                        out.append(one.row())
                        waiting += sum(len(x) for x in out[-1] if isinstance(x, str))
                    one = make(conv)
                    if len(out) >= 4096 or waiting > 1 << 22:
                        yield _batch(out, ddl)
                        out, waiting = [], 0
                one.feed(*rest)
        if one is not None:
            out.append(one.row())
        yield _batch(out, ddl)

    return run


class _Repaired:
    """Digest of one repaired conversation. First comes a row with its edits, then its rows in order."""

    def __init__(self, conv):
        self.conv, self.digest, self.state, self.any = conv, hashlib.sha256(), NOTHING, False
        self.audit, self.at = "", 0

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _turn(self, text: str) -> None:
        self.state = A if self.state == U else U
        self._write(_NAMES[self.state], text)

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._turn("")
            self.at += 1

    def feed(self, audit: str | None, copies: int, role: str, text: str) -> None:
        if audit is not None:
            self.audit = audit
            return
        for _ in range(copies):
            self._insert()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "R":
                self._turn(text)
            elif edit == "K":
                self._write(role, text)
                self.state = {"u": U, "a": A}.get(role[:1], S)

    def row(self) -> tuple:
        self._insert()
        return self.conv, self.digest.hexdigest()


def repair(conversations: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation of
    ``conversations(conv_id, turn, role, text, copies)``, as ``damage`` gives it.

    Rows go by turn (null first), then role, then a hash of the text; rows alike in all three are copies of one another. ``gaps``
    counts the turns missing between the least and the greatest, up to 2^63 - 1. A null conv_id is a conversation of
    its own. Null copies are none, null roles or texts empty. A conversation without rows has zeros, no edits and the
    digest of an empty text. Blank texts are faults, very long ones are read whole. An empty table gives an empty result.
    Other columns are ignored, whatever their names.

    A digest is made of a conversation's rows in order, so one task reads them, row by row; it holds one letter for each.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies")
    )
    rows = materialise(_faulty(rows), "faults")
    narrow = rows.drop("text")
    signed = map_batches(_in_order(narrow).select("conv_id", "turn", "copies", "letter", "initial", "fresh"), _by_conversation(_Signature, _SIGNED), _SIGNED)
    signed = materialise(signed, "signed")
    audits = materialise(cheapest_edits(signed), "audits")
    judged = materialise(signed.join(audits, "signature").drop("signature"), "judged")
    heads = judged.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), "audit", F.lit(0).cast("long").alias("copies"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("tie_"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", F.lit(None).cast("string").alias("audit"), "copies", "role", "text", "tie", "tie_")
    stream = _in_order(heads.unionByName(body), "kind").select("conv_id", "audit", "copies", "role", "text")
    digests = map_batches(stream, _by_conversation(_Repaired, _REPAIRED), _REPAIRED).withColumnRenamed("conv_id", "conv_id_")
    found = judged.join(digests, F.col("conv_id").eqNullSafe(F.col("conv_id_")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
