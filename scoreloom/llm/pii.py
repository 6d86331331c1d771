"""Personal data by candidate gradient boosting.

Base patterns find emails, IP addresses, card numbers and phone numbers; they always stay. High-recall
generators then propose further, overlapping candidates: obfuscated addresses, numbers without a country
code, cards in unusual groups, and numbers that stand next to others, so that a base pattern reads them as one and
drops them. Boosted trees score each candidate by its format and the words around
it; candidates above their kind's calibrated threshold are added where nothing is redacted yet, best first.

The trees are trained here, on ``TRAINING_TEXTS`` sentences drawn from templates with known spans; each
kind's threshold is the lowest one with a precision of ``PRECISION`` on sentences held back from training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import boosting
from scoreloom.llm import text as tx
from scoreloom.llm.calibration import calibrate
from scoreloom.llm.spans import Span, code_points, join_spans, redact, sha256_hex
from scoreloom.llm.storage import map_batches

KINDS = ("email", "ip", "card", "phone")
TRAINING_TEXTS = 4000
PRECISION = 0.98

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)


def digits_of(raw: bytes) -> bytes:
    return raw.translate(None, _NOT_DIGIT)


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(raw: bytes) -> list[Span]:
    """A match begins where the run of local characters before an ``@`` begins, or the match before ends."""
    found, last, at = [], 0, raw.find(b"@")
    while at >= 0:
        local = raw[last:at]
        start = at - (len(local) - len(local.rstrip(_LOCAL)))
        last = at + 1
        domain = _DOMAIN.match(raw, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            last = domain.end()
        at = raw.find(b"@", last)
    return found


def _octet(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) <= 3 and int(part or b"0") <= 255


def base_spans(raw: bytes) -> list[Span]:
    """Spans of the base patterns in bytes: by kind as listed, then start."""
    found = _emails(raw)
    if _DIGIT.search(raw):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(raw) if all(map(_octet, m[0].split(b".")))]
        for m in _CARD.finditer(raw):
            if len(m[0]) >= 16 and 16 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(raw) if 8 <= len(digits_of(m[0])) <= 15]
    return found


_DIGIT = re.compile(rb"[0-9]")
#: High-recall generators; a candidate's kind is the generator's.
GENERATORS = (
    ("email", re.compile(rb"[A-Za-z0-9._%+-]{1,64} ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({<] ?(?:dot|DOT|\.) ?[\])}>]) ?[A-Za-z0-9-]{1,63}){1,4}")),
    ("email", re.compile(rb"[A-Za-z0-9._%+-]{1,64} (?:at|AT) [A-Za-z0-9-]{1,63}(?: (?:dot|DOT) [A-Za-z0-9-]{1,63}){1,4}")),
    ("ip", re.compile(rb"(?<![0-9.])[0-9]{1,3}(?: ?[.] ?[0-9]{1,3}){3}(?![0-9.])")),
    ("ip", re.compile(rb"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(rb"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,3}[0-9]{2,6}){2,4}(?![0-9])")),
    ("card", re.compile(rb"(?<![0-9.])[0-9]{13,19}(?![0-9])")),
    ("phone", re.compile(rb"\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]{1,2}[0-9]{2,4}){2}(?![0-9])")),
    ("phone", re.compile(rb"\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]{1,2}[0-9]{2,4}){3,4}(?![0-9])")),
    ("phone", re.compile(rb"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]{1,2}[0-9]{2,4}){2,4}(?![0-9])")),
    ("phone", re.compile(rb"(?<![0-9+.])0?[0-9]{9,11}(?![0-9])")),
)
#: Words that speak for each kind, and for none of them (fixed values).
CUES = {
    "email": ("mail", "email", "e-mail", "write", "contact", "reach"),
    "ip": ("ip", "host", "server", "address", "from", "client", "login"),
    "card": ("card", "visa", "credit", "debit", "pay", "payment", "mastercard"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell", "dial", "text"),
    "none": ("version", "release", "build", "order", "invoice", "ref", "isbn", "serial", "page", "id", "item", "total", "part", "section", "figure"),
}
_CUE_PATTERNS = {k: re.compile(rb"\b(?:" + b"|".join(re.escape(w.encode()) for w in words) + rb")\b", re.IGNORECASE) for k, words in CUES.items()}


def features(raw: bytes, kind: str, a: int, b: int) -> list[float]:
    """Format of the candidate and context before and after it."""
    text, before, after = raw[a:b], raw[max(0, a - 32) : a], raw[b : b + 16]
    digits = digits_of(text)
    groups = re.findall(rb"[0-9]+", text)
    numbers = [g for g in groups if len(g) <= 3]
    row = [float(kind == k) for k in KINDS]
    row += [len(text), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0)]
    row += [len(set(digits)), float(luhn(digits)) if digits else 0.0, float(len(numbers) == 4 and all(int(n) <= 255 for n in numbers))]
    row += [text.count(b" "), text.count(b"."), text.count(b"-"), text.count(b"("), float(text[:1] == b"0"), float(text[:2] == b"00"), float(text[:1] == b"+")]
    row += [sum(65 <= c <= 90 or 97 <= c <= 122 for c in text), float(b"at" in text.lower()), float(b"dot" in text.lower())]
    row += [float(bool(p.search(before))) for p in _CUE_PATTERNS.values()]
    row += [float(bool(re.search(rb"\+[0-9]{1,3}[ .-]?$", before))), float(bool(re.search(rb"[0-9][ .-]{0,2}$", before))), float(bool(re.match(rb"[ .-]{0,2}[0-9]", after)))]
    row += [float(before[-1:].isalnum()), float(before[-1:] in (b"#", b"$", b"=", b"v")), float(before.rstrip()[-1:] == b":"), float(after[:1].isalnum()), float(after[:1] in (b"%", b"$"))]
    return row


def candidates(raw: bytes) -> list[Span]:
    found = []
    if _DIGIT.search(raw) or b" at " in raw or b" AT " in raw or b"@" in raw or _BRACKET_AT.search(raw):
        for kind, pattern in GENERATORS:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(raw)]
    return found


_BRACKET_AT = re.compile(rb"[\[({<] ?(?:at|AT)\b")


@dataclass
class Detector:
    trees: boosting.BoostedTrees
    scale: tuple[float, float]
    thresholds: dict[str, float]

    def probabilities(self, rows: list[list[float]]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.trees.margins(np.array(rows, float)) + b)))

    def added(self, raw: bytes, base: list[Span]) -> list[Span]:
        """Candidates beyond ``base`` that pass, best first, none overlapping another span."""
        covered = np.zeros(len(raw), bool)
        for _, a, b in base:
            covered[a:b] = True
        open_ = [c for c in dict.fromkeys(candidates(raw)) if not covered[c[1] : c[2]].any()]
        if not open_:
            return []
        scores = self.probabilities([features(raw, *c) for c in open_])
        taken: list[Span] = []
        for k in np.lexsort(([c[1] for c in open_], -scores)):
            kind, a, b = open_[k]
            if scores[k] >= self.thresholds[kind] and not covered[a:b].any():
                taken.append((kind, a, b))
                covered[a:b] = True
        return taken


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng: np.random.Generator, good: bool) -> str:
    """Sixteen digits that pass Luhn's test, or fail it."""
    body = str(rng.integers(3, 7)) + _number(rng, 14)
    return next(body + str(c) for c in rng.permutation(10) if luhn((body + str(c)).encode()) == good)


def _side_by_side(rng: np.random.Generator) -> list[tuple[str, str, bool]]:
    """Two numbers with a blank between them."""
    phone = f"+{rng.integers(1, 99)} ({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}"
    good = bool(rng.integers(2))
    first = [("phone", phone, True), ("card", _card(rng, good), good), ("ip", ".".join(str(rng.integers(1, 256)) for _ in range(4)), True), ("none", _number(rng, int(rng.integers(2, 8))), False)]
    good = bool(rng.integers(2))
    second = [("card", _card(rng, good), good), ("none", _number(rng, int(rng.integers(2, 20))), False)]
    pair = [first[int(rng.integers(len(first)))], second[int(rng.integers(len(second)))]]
    return pair if rng.integers(2) else pair[::-1]


def _sentence(rng: np.random.Generator) -> tuple[bytes, list[tuple[str, str, bool]]]:
    """A made-up sentence, and its number-like or address-like parts as (kind, text, personal)."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    number = lambda n: _number(rng, n)
    word = lambda: "".join(pick("an", "er", "to", "li", "sha", "ne", "mo", "ri", "ka", "den") for _ in range(int(rng.integers(1, 4))))
    at, dot = pick(" [at] ", " (at) ", " at ", "(at)", "[at]"), pick(" [dot] ", " (dot) ", " dot ", ".")
    sep = pick(" ", "-", ".")
    form = pick("personal", "personal", "other", "other", "pair")
    if form == "pair":
        parts = _side_by_side(rng)
        cue = pick(*CUES[pick(*CUES)]) if rng.random() < 0.2 else word()
    elif form == "personal":
        kind = pick(*KINDS)
        made = {
            "email": f"{word()}{at}{word()}{dot if at != ' at ' else ' dot '}{pick('com', 'org', 'net', 'de')}",
            "ip": pick(".".join(str(rng.integers(1, 256)) for _ in range(4)), ":".join(f"{rng.integers(65536):x}" for _ in range(8))).replace(".", pick(" . ", ". ")),
            "card": pick("/", ".", "  ").join(re.findall("....", _card(rng, True))),
            "phone": pick(f"({number(3)}) {number(3)}-{number(4)}", f"0{number(3)}{sep}{number(3)}{sep}{number(4)}", f"00{pick('44', '49', '33', '1')} {number(3)} {number(3)} {number(4)}"),
        }[kind]
        parts = [(kind, made, True)]
        cue = pick(*CUES[kind]) if rng.random() < 0.9 else word()
    else:
        kind = pick(*KINDS)
        made = {
            "email": f"{word()} at {word()} dot {word()}",
            "ip": ".".join(str(rng.integers(0, 999)) for _ in range(4)),
            "card": pick(_card(rng, False), number(13), f"{number(4)}-{number(2)}-{number(2)}", f"{number(4)} {number(4)} {number(4)}"),
            "phone": pick(f"{number(3)}-{number(2)}-{number(3)}", f"{number(2)} {number(3)} {number(3)}", number(10), f"{number(2)}.{number(2)}.{number(4)}"),
        }[kind]
        parts = [(kind, made, False)]
        cue = pick(*CUES["none"]) if rng.random() < 0.6 else word()
    before = pick(" ", ": ", " = ", " # " if form == "other" else " ")
    text = f"{word()} {word()} {cue}{before}{' '.join(p for _, p, _ in parts)}{pick(' ', '. ', ', ')}{word()} {word()}"
    return text.encode(), parts


def train(texts: int = TRAINING_TEXTS, seed: int = 11) -> Detector:
    """Fit on three quarters of the sentences; calibrate and choose thresholds on the rest."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rows, labels, kinds, part = [], [], [], []
    for i in range(texts):
        raw, truth = _sentence(rng)
        found = base_spans(raw)
        for kind, a, b in dict.fromkeys(candidates(raw)):
            if any(x < b and a < y for _, x, y in found):
                continue
            wanted = any(p and kind == k and raw[a:b].strip() in t.encode() and 10 * (b - a) >= 9 * len(t) for k, t, p in truth)
            rows.append(features(raw, kind, a, b))
            labels.append(wanted)
            kinds.append(kind)
            part.append(i % 4)
    x, y, held = np.array(rows, float), np.array(labels, float), np.array(part) == 0
    trees = boosting.fit(x[~held], y[~held])
    margins = trees.margins(x[held])
    scale = calibrate(margins, y[held])
    p = 1 / (1 + np.exp(-(scale[0] * margins + scale[1])))
    thresholds = {}
    for kind in KINDS:
        own = np.array(kinds)[held] == kind
        thresholds[kind] = _lowest_threshold(p[own], y[held][own])
    return Detector(trees, scale, thresholds)


def _lowest_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The lowest score from which on at least ``PRECISION`` of the candidates are personal; at least 0.5."""
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(y[order]) >= PRECISION * np.arange(1, len(y) + 1)
    return max(0.5, float(p[order][np.flatnonzero(good)[-1]])) if good.any() else 1.1


def _find(detector: Detector):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.utf8(batch.column("text"))
            counts, digests, joined = [], [], []
            for i in range(len(offsets) - 1):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                base = base_spans(raw)
                more = detector.added(raw, base)
                points = code_points(raw, base)
                every = sorted(points + code_points(raw, more), key=lambda s: (KINDS.index(s[0]), s[1]))
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                digests.append(sha256_hex(join_spans(points)))
                joined.append(join_spans(every))
            table = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return run


def find_pii(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no spans; very long ones are read whole. Repeated rows are searched alike; a null doc_id is
    passed through; candidates that score alike go by their place; an empty table gives an empty result. Other columns are
    ignored. ``n_`` columns and the digest cover the base spans, ``spans`` the added ones as well.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(base, _find(detector or train()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _redacted(detector: Detector):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                base = base_spans(raw)
                texts.append(text if text is None else redact(text, code_points(raw, base + detector.added(raw, base))))
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return run


def redact_pii(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, and all other columns, whatever their names, as they are.
    Null and empty texts stay, very long ones are read whole; of spans that overlap the first, then the longest, is
    replaced; a null or repeated doc_id makes no difference; an empty table stays empty."""
    return map_batches(docs, _redacted(detector or train()), docs.schema)
