"""Regex spans of UTF-8 texts: leftmost and non-overlapping per kind, in code points."""

from __future__ import annotations

import hashlib

import numpy as np

Span = tuple[str, int, int]


def code_points(raw: bytes, spans: list[Span]) -> list[Span]:
    """Byte positions as code point positions."""
    if not spans or raw.isascii():
        return spans
    lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    before = lambda at: int(lead[at - 1]) if at else 0
    return [(kind, before(a), before(b)) for kind, a, b in spans]


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def overlaps(spans: list[Span], a: int, b: int) -> bool:
    return any(x < b and a < y for _, x, y in spans)


def redact(text: str, spans: list[Span], mark: str = "[{}]") -> str:
    """``text`` with each span replaced by its kind in capitals; of overlapping spans the first stays."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            continue
        out += [text[at:a], mark.format(kind.upper())]
        at = b
    return "".join([*out, text[at:]])
