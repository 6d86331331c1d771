"""JSON maps by ranges against whole reading; binary .doc files built here, whole and broken."""

import json
import random
import struct

import pytest

from scoreloom.sources import jsonmap, readers
from scoreloom.sources.compound import Compound, doc_text, is_compound


def strict_map(raw):
    """The entries of a file that is one JSON map, else none."""
    try:
        text = raw.decode("utf-8-sig")
        found = json.loads(text, object_pairs_hook=lambda pairs: ("map", pairs))
    except ValueError:
        return []
    return [(k, json.dumps(plain(v))) for k, v in found[1]] if isinstance(found, tuple) else []


def plain(v):
    return {k: plain(x) for k, x in v[1]} if isinstance(v, tuple) else [plain(x) for x in v] if isinstance(v, list) else v


def by_ranges(path, size):
    """What the two jobs do, here."""
    import pandas as pd

    raw = open(path, "rb").read()
    bounds = [(b, min(b + size, len(raw))) for b in range(0, len(raw), size)]
    frame = pd.DataFrame({"path": path, "begin": [b for b, _ in bounds], "end": [e for _, e in bounds]})
    effects = next(jsonmap._effects(iter([frame])))
    starts = list(jsonmap.begin_states(effects.to_dict("records")))
    if not starts:
        return []
    frame = pd.DataFrame(starts, columns=[x.split()[0] for x in jsonmap._STARTS.split(", ")])
    rows = [x for f in jsonmap._records(iter([frame])) for x in f.itertuples(index=False)]
    wrong = [x for x in rows if x.key is None or x.key != x.key]
    good = [(x.key, json.dumps(json.loads(x.value))) for x in rows if isinstance(x.key, str)]
    if wrong and not (len(wrong) == 1 and wrong[0].value == "" and not good):
        return []
    return good


def some_map(rng):
    texts = ['pl"ain', "back\\slash\\", "{", "}", '",', "é日本😀", "", "a\nb", "[,]", '\\"', "x" * 50]
    value = lambda d: rng.choice((rng.choice(texts), rng.random(), None, True)) if d > 2 or rng.random() < 0.4 else rng.choice(({rng.choice(texts) + str(k): value(d + 1) for k in range(rng.randrange(3))}, [value(d + 1) for _ in range(rng.randrange(3))]))
    return {rng.choice(texts) + str(k): value(0) for k in range(rng.randrange(8))}


def test_ranges_of_any_size_give_the_whole_map(tmp_path, monkeypatch):
    rng = random.Random(1)
    for n in range(150):
        text = json.dumps(some_map(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1)))
        if n % 3 == 0:  # broken, or not one map
            cut = rng.randrange(len(text) + 1)
            text = rng.choice((text[:cut], text + text, text + " x", "x " + text, f"[{text}]", text[:cut] + rng.choice(('"', "}", "{", ",", "\\")) + text[cut:], text.replace("}", ",}", 1), "﻿" + text, f" \n{text}\t\n"))
        path = tmp_path / f"{n}.json"
        path.write_bytes(text.encode())
        for size, block in ((1, 7), (5, 3), (17, 64), (10_000, 2), (10_000, 10_000)):
            monkeypatch.setattr(jsonmap, "BLOCK", block)
            assert by_ranges(str(path), size) == strict_map(text.encode()), (n, size, block, text)


def test_json_maps_in_spark(spark, tmp_path):
    folder = tmp_path / "maps with blanks %20"
    folder.mkdir()
    records = {f"c{k}": {"title": f"t{k}", "case_text": f"text, {{{k}}} \"q\" \\ é\n" * (k % 50), "metadata": {"k": str(k)}} for k in range(2000)}
    whole = json.dumps(records, ensure_ascii=False)
    (folder / "big.json").write_text(whole, encoding="utf-8")
    (folder / "tail.json").write_text(whole[: len(whole) - 5], encoding="utf-8")
    (folder / "middle.json").write_text(whole.replace('"c1000":', '"c1000";'), encoding="utf-8")
    (folder / "empty.json").write_text("{ }", encoding="utf-8")
    (folder / "nothing.json").write_text("", encoding="utf-8")
    for size in (20_000, 32 << 20):
        rows = jsonmap.read_json_map(spark, str(folder), readers.CASE, size=size)
        got = {r["case_id"]: r for r in rows.collect()}
        assert rows.count() == len(got) == 2000
        assert all(got[k]["title"] == v["title"] and got[k]["case_text"] == v["case_text"] and got[k]["metadata"] == v["metadata"] and got[k]["judge_decision"] is None for k, v in records.items())
    assert readers.case_store(spark, str(folder / "empty.json")).count() == 0


# Binary .doc files.


def compound(streams, sector=512, mini=64, cutoff=4096):
    """A compound file of these streams: small ones in small sectors."""
    sectors, fat = [], []

    def put(raw):
        n = max(1, -(-len(raw) // sector))
        first = len(sectors)
        sectors.extend(raw[k * sector : (k + 1) * sector].ljust(sector, b"\0") for k in range(n))
        fat.extend([*range(first + 1, first + n), 0xFFFFFFFE])
        return first

    small, mini_fat, places = b"", [], {}
    for name, raw in streams.items():
        if len(raw) < cutoff:
            first, n = len(mini_fat), -(-len(raw) // mini)
            small += raw.ljust(n * mini, b"\0")
            mini_fat += [*range(first + 1, first + n), 0xFFFFFFFE]
            places[name] = first
        else:
            places[name] = put(raw)
    root = put(small)
    mini_at = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat) + b"\xff" * 4) if mini_fat else 0xFFFFFFFE

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, size)

    directory = put(entry("Root Entry", 5, root, len(small)) + b"".join(entry(n, 2, places[n], len(r)) for n, r in streams.items()))
    n_fat = 1
    while n_fat * sector // 4 < len(sectors) + n_fat:
        n_fat += 1
    at = [len(sectors) + k for k in range(n_fat)]
    table = (fat + [0xFFFFFFFD] * n_fat) + [0xFFFFFFFF] * (n_fat * sector // 4 - len(fat) - n_fat)
    sectors.extend(struct.pack(f"<{sector // 4}I", *table[k * sector // 4 : (k + 1) * sector // 4]) for k in range(n_fat))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<9I", 0, n_fat, directory, 0, cutoff, mini_at, 1, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *at, *[0xFFFFFFFF] * (109 - n_fat))
    return head + b"".join(sectors)


def word_file(pieces, flags=0x0200, extra="", table="1Table", lead=b""):
    """A document of (text, one byte a character) pieces; ``extra`` stands behind the main text."""
    body, places, bounds, at = b"", [], [0], 0x800
    for text, single in [*pieces, *([(extra, False)] if extra else [])]:
        raw = text.encode("cp1252" if single else "utf-16-le")
        places.append((at + len(body)) * 2 | 0x40000000 if single else at + len(body))
        body += raw
        bounds.append(bounds[-1] + (len(raw) if single else len(raw) // 2))
    plc = struct.pack(f"<{len(bounds)}I", *bounds) + b"".join(struct.pack("<HIH", 0, p, 0) for p in places)
    clx = lead + b"\x02" + struct.pack("<I", len(plc)) + plc
    fib = bytearray(0x800)
    struct.pack_into("<HHH", fib, 0, 0xA5EC, 0xC1, 0)
    struct.pack_into("<H", fib, 10, flags)
    struct.pack_into("<I", fib, 76, bounds[-1] - len(extra.encode("utf-16-le")) // 2)
    struct.pack_into("<II", fib, 0x1A2, 40, len(clx))
    return compound({"WordDocument": bytes(fib) + body, table: b"\0" * 40 + clx})


def test_binary_documents_give_their_text():
    plain = [("原告诉称：“法院”\r第二段\x07", False), ("café “quoted”\r", True), ("尾😀\r\r  \r", False)]
    assert doc_text(word_file(plain)) == "原告诉称：“法院”\n第二段\ncafé “quoted”\n尾😀"
    assert doc_text(word_file(plain, flags=0, table="0Table")) == doc_text(word_file(plain))
    assert doc_text(word_file(plain, extra="a footnote\r", lead=b"\x01" + struct.pack("<H", 3) + b"abc")) == doc_text(word_file(plain))
    assert doc_text(word_file([("see \x13 HYPERLINK \"x\" \x14the link\x15 and \x13 PAGE \x15.\r", False)])) == "see the link and ."
    long = "第一千零七十九条。\r" * 20_000
    assert doc_text(word_file([(long, False)])) == "\n".join(["第一千零七十九条。"] * 20_000)
    assert doc_text(word_file([("", False)])) == ""


def test_broken_documents_have_no_text():
    good = word_file([("原告诉称，" * 2000, False)])
    assert doc_text(good) and is_compound(good) and Compound(good).entries
    assert doc_text(b"") is None and doc_text(b"text") is None and doc_text(good[:600]) is None and doc_text(good[: len(good) // 2]) is None
    assert doc_text(word_file([("secret", False)], flags=0x0300)) is None and doc_text(word_file([("x", False)], flags=0)) is None
    rng = random.Random(3)
    for _ in range(400):  # nothing but None or a text comes of any damage
        raw = bytearray(good)
        for _ in range(rng.randrange(1, 6)):
            raw[rng.choice((rng.randrange(512), rng.randrange(len(raw)), len(raw) - rng.randrange(1, 2048)))] = rng.randrange(256)
        assert doc_text(bytes(raw)) is None or isinstance(doc_text(bytes(raw)), str)
    loop = bytearray(compound({"WordDocument": b"\0" * 5000}))
    assert doc_text(bytes(loop)) is None


@pytest.mark.parametrize("suffix", ["doc", "DOC"])
def test_folder_of_documents(spark, tmp_path, suffix):
    (tmp_path / f"a.{suffix}").write_bytes(word_file([("本院认为，应予支持。\r", False)]))
    (tmp_path / f"b.{suffix}").write_bytes(word_file([("x", False)])[:700])
    (tmp_path / f"c.{suffix}").write_bytes(("本院认为的法" * 40).encode("gbk"))
    got = {r["path"].rsplit("/", 1)[1][0]: r["content"] for r in readers.document_folder(spark, str(tmp_path)).collect()}
    assert got["a"] == "本院认为，应予支持。" and got["b"] is None and got["c"] == "本院认为的法" * 40
