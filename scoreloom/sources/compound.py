"""Text of binary .doc files: the streams of a compound file, and the pieces of the text in them."""

from __future__ import annotations

import struct

_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Sector numbers from here on are marks, not sectors (fixed values of the format).
_END = 0xFFFFFFFA
#: Characters that stand for something else in the text (fixed values of the format): paragraph, cell and page ends are line ends.
_BREAKS = dict.fromkeys(map(chr, (0x07, 0x0B, 0x0C, 0x0D)), "\n")
_FIELD_BEGIN, _FIELD_MIDDLE, _FIELD_END = "\x13", "\x14", "\x15"
#: What bytes from 0x80 to 0x9F mean in pieces of one byte a character.
_PIECE = "cp1252"


class Broken(ValueError):
    """The file doesn't follow its format."""


def is_compound(content: bytes) -> bool:
    return content[:8] == _MAGIC


def _numbers(raw: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, content: bytes):
        if not is_compound(content) or len(content) < 512:
            raise Broken("no compound file")
        self.content = content
        shift, mini = struct.unpack_from("<HH", content, 30)
        if not 7 <= shift <= 16 or not 2 <= mini < shift:
            raise Broken("sector size")
        self.size, self.mini_size = 1 << shift, 1 << mini
        _, _, directory, _, self.cutoff, mini_fat, _, difat, _ = struct.unpack_from("<9I", content, 40)
        sectors = list(struct.unpack_from("<109I", content, 76))
        seen = set()
        while difat < _END:  # further lists of allocation sectors
            if difat in seen:
                raise Broken("a loop of sectors")
            seen.add(difat)
            more = _numbers(self._sector(difat))
            sectors += more[:-1]
            difat = more[-1]
        self.fat = [n for s in sectors if s < _END for n in _numbers(self._sector(s))]
        entries = self._chain(directory)
        self.entries = {}
        for at in range(0, len(entries) - 127, 128):
            length = struct.unpack_from("<H", entries, at + 64)[0]
            if 2 <= length <= 64 and entries[at + 66]:
                name = entries[at : at + length - 2].decode("utf-16-le", "replace")
                start, low = struct.unpack_from("<II", entries, at + 116)
                self.entries.setdefault(name, (entries[at + 66], start, low))
        root = next((e for e in self.entries.values() if e[0] == 5), None)
        if root is None:
            raise Broken("no root")
        self.mini = self._chain(root[1])[: root[2]] if root[1] < _END else b""
        self.mini_fat = _numbers(self._chain(mini_fat)) if mini_fat < _END else ()

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        if at >= len(self.content):
            raise Broken("a sector beyond the end")
        return self.content[at : at + self.size]

    def _chain(self, n: int) -> bytes:
        parts, seen = [], set()
        while n < _END:
            if n in seen or n >= len(self.fat):
                raise Broken("a chain of sectors")
            seen.add(n)
            parts.append(self._sector(n))
            n = self.fat[n]
        return b"".join(parts)

    def stream(self, name: str) -> bytes:
        if name not in self.entries or self.entries[name][0] != 2:
            raise Broken(f"no stream {name}")
        _, n, length = self.entries[name]
        if length >= self.cutoff:
            found = self._chain(n)
        else:
            parts, seen = [], set()
            while n < _END:
                if n in seen or n >= len(self.mini_fat):
                    raise Broken("a chain of small sectors")
                seen.add(n)
                parts.append(self.mini[n * self.mini_size : (n + 1) * self.mini_size])
                n = self.mini_fat[n]
            found = b"".join(parts)
        if len(found) < length:
            raise Broken(f"stream {name} is cut off")
        return found[:length]


def _pieces(table: bytes) -> tuple[tuple[int, ...], list[tuple[int, bool]]]:
    """Bounds of the pieces in characters, and where each begins in the main stream: at one byte a character or two."""
    at = 0
    while at < len(table) and table[at] == 1:  # formatting that pieces refer to
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if at + 5 > len(table) or table[at] != 2:
        raise Broken("no table of pieces")
    length = struct.unpack_from("<I", table, at + 1)[0]
    raw = table[at + 5 : at + 5 + length]
    if len(raw) < length or (length - 4) % 12:
        raise Broken("the table of pieces is cut off")
    n = (length - 4) // 12
    bounds = _numbers(raw[: 4 * (n + 1)])
    places = [struct.unpack_from("<I", raw, 4 * (n + 1) + 8 * k + 2)[0] for k in range(n)]
    return bounds, [((p & 0x3FFFFFFF) // 2, True) if p & 0x40000000 else (p, False) for p in places]


def _bare(text: str) -> str:
    """Without fields' instructions and marks, with line ends."""
    out, instruction = [], []
    for c in text:
        if c == _FIELD_BEGIN:
            instruction.append(True)
        elif c == _FIELD_MIDDLE and instruction:
            instruction[-1] = False
        elif c == _FIELD_END and instruction:
            instruction.pop()
        elif not any(instruction):
            out.append(_BREAKS.get(c, c))
    kept = "".join(c for c in out if c >= " " or c in "\n\t")
    return "\n".join(x.strip() for x in kept.split("\n") if x.strip())


def doc_text(content: bytes) -> str | None:
    """The main text of a binary .doc file, non-blank lines; None for a file that is broken, encrypted or of an older format. Headers, notes and
    comments stand behind the main text and are left out."""
    try:
        file = Compound(content)
        main = file.stream("WordDocument")
        if len(main) < 0x1AA or struct.unpack_from("<H", main, 0)[0] != 0xA5EC:
            raise Broken("no document")
        flags = struct.unpack_from("<H", main, 10)[0]
        if flags & 0x0100:
            raise Broken("encrypted")
        length = struct.unpack_from("<I", main, 76)[0]
        begin, size = struct.unpack_from("<II", main, 0x1A2)
        table = file.stream("1Table" if flags & 0x0200 else "0Table")
        if begin + size > len(table):
            raise Broken("the table of pieces lies beyond its stream")
        bounds, places = _pieces(table[begin : begin + size])
        parts = []
        for low, high, (at, single) in zip(bounds[:-1], bounds[1:], places, strict=True):
            n = min(high, length) - low
            if high < low:
                raise Broken("pieces out of order")
            if n <= 0:
                continue
            width = n if single else 2 * n
            if at + width > len(main):
                raise Broken("a piece beyond the end")
            parts.append(main[at : at + width].decode(_PIECE if single else "utf-16-le", "replace"))
        return _bare("".join(parts))
    except (Broken, struct.error, IndexError):
        return None
