"""Conversation repair, token counts and phrase mining against brute force, on small tables."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scoreloom.llm import phrases, repair, tokens
from scoreloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"

# 11 conversation structure


def all_edits(signature):
    """The cheapest edits and the first of them by ASCII, by trying all."""
    best = None

    def go(i, state, cost, text, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(signature) and state in (repair.NOTHING, repair.A):
            best = min(best or (cost, text), (cost, text))
        if inserts < 3:
            go(i, repair.A if state == repair.U else repair.U, cost + 3, text + "I", inserts + 1)
        if i < len(signature):
            letter = signature[i]
            go(i + 1, state, cost + 4, text + "D", 0)
            if letter != "x":
                late = 3 * letter.isupper()
                turn = repair.A if state == repair.U else repair.U
                go(i + 1, turn, cost + 3 + late, text + "R", 0)
                if letter.lower() == {repair.U: "u", repair.A: "a"}[turn]:
                    go(i + 1, turn, cost + late, text + "K", 0)
                if letter.lower() == "s" and state == repair.NOTHING:
                    go(i + 1, repair.S, cost + late, text + "K", 0)

    go(0, repair.NOTHING, 0, "", 0)
    return best


def shortest_path(signature):
    """The same for longer signatures: states in the order of cost, then text."""
    heap, seen = [(0, "", 0, repair.NOTHING)], set()
    while heap:
        cost, text, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(signature) and state in (repair.NOTHING, repair.A):
            return cost, text
        heapq.heappush(heap, (cost + 3, text + "I", i, repair.A if state == repair.U else repair.U))
        if i < len(signature):
            for end, more, edit in repair._steps(state, signature[i]):
                heapq.heappush(heap, (cost + more, text + edit, i + 1, end))


def test_trie_answers_are_the_cheapest_and_first():
    rng = random.Random(1)
    short = ["".join(p) for n in range(4) for p in itertools.product("xuasoUASO", repeat=n)]
    short += ["".join(rng.choice("xuasoUASO") for _ in range(rng.randrange(4, 8))) for _ in range(300)]
    trie = repair.Trie()
    for s in sorted(set(short)):
        assert trie.insert(s) == all_edits(s) == shortest_path(s), s
    assert trie.made < sum(map(len, set(short))) / 2  # shared prefixes are worked out once
    for letters in ("uauauauaxsUAo", "uuuuuu", "aaaaax", "xxxxxo", "ssssu"):
        s = "".join(rng.choice(letters) for _ in range(300))
        assert repair.Trie().insert(s) == shortest_path(s)


def test_layers_are_few_at_any_length():
    rng = random.Random(2)
    trie = repair.Trie()
    cost, audit = trie.insert("".join(rng.choice("uaUAsSoOx") for _ in range(100_000)))
    assert len(trie.layers.layers) < 500 and len(audit) >= 100_000 and cost > 0


def brute_repair(rows):
    """Rows (conv, turn, role, text) of one conversation, with turns that don't tie."""
    out = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    seen, counts, signature = set(), Counter(), ""
    for _, role, text in out:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        counts[fault] += 1
        letter = role[:1] if role[:1] in ("u", "a", "s") else "o"
        signature += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
    turns = [t for t, _, _ in out if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = shortest_path(signature)
    at, state, kept = iter(out), "", []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)[1:]
        if edit == "D":
            continue
        if edit in "RI":
            role = "assistant" if state == "u" else "user"
        state = role[:1]
        kept.append(f"{role}:{text}")
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


CONVERSATIONS = "conv_id long, turn long, role string, text string, copies string, letter string, tie string"


def conversations_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CONVERSATIONS)


def checked(spark, rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    got = {r[0]: tuple(r)[1:] for r in repair.repair(repair.damage(conversations_of(spark, rows))).collect()}
    assert set(got) == set(by)
    for conv, own in by.items():
        assert got[conv] == brute_repair(own), (conv, own)
    return got


def test_repair_against_brute_force(spark):
    rng = random.Random(4)
    lines = ["Yes.", "No!", "Why?", "well", "  \t", "", None, "Yes. ", "ends here.\n\n", "cut off\n", "é.", "。", "a" * 50_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "userland", "A"]
    rows = []
    for conv in [None, *range(120), -5]:
        turns = rng.sample([None, *range(-2, 30)], rng.randrange(1, 12))
        rows += [(conv, t, rng.choice(roles[: rng.choice((2, 3, 8))]), rng.choice(lines)) for t in turns]
    got = checked(spark, rows)
    assert {"D", "I", "K", "R"} <= set("".join(x[6] for x in got.values()))


def test_repair_of_one_long_conversation(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(("user", "assistant")), rng.choice(("Same.", f"Text {t}.", f"cut {t}"))) for t in range(3000)]
    checked(spark, [*rows, (2, 0, "user", "Hi."), (2, 1, "assistant", "Hello.")])


def test_repair_edges(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    plain = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(4)))
    rows = [(dropped, 0, "user", "Hi."), (plain, 0, "user", "Hi."), (plain, 0, "user", "Hi."), (plain, 0, "assistant", "Oh."), (plain, 3, "assistant", "Oh."), (plain, None, "system", "Be kind.")]
    got = {r["conv_id"]: r for r in repair.repair(repair.damage(conversations_of(spark, rows))).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    # system, then of the tied turn assistant before user and its copy, then the assistant's duplicate
    assert got[plain]["gaps"] == 2 and got[plain]["duplicate"] == 2 and got[plain]["blank"] == 0
    assert got[plain]["audit"] == shortest_path("sauxx")[1]
    again = repair.repair(repair.damage(conversations_of(spark, rows[::-1]))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.values()))
    assert repair.repair(repair.damage(conversations_of(spark, rows).limit(0))).count() == 0


def test_repair_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append(tuple(r))
    got = {r[0]: tuple(r)[1:] for r in queries()["op11_trie_repair"](spark, SF).collect()}
    assert got == {c: brute_repair(own) for c, own in by.items()}


# 12 token counts


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def library(path, texts):
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = [
    None, "", " ", "\n\n \t", "a", "It's the dog's; they'll've", "<|endoftext|>", "a<|endoftext|><|startoftext|>b <|EndOfText|>", "<|endoftext|", "x<|<|endoftext|>|>",
    "İstanbul ΣΑΣ ΟΔΟΣ. ﬁ Å é", "é́ ȩ́ ́start", "한국어 텍스트 한", "汉字没有空格" * 40, "😀👩‍👩‍👧 ok​zero nb em　x\u0085y\x1cz",
    "0123456789 3.14 １２３ ²³", "tab\tnl\r\nvt\x0bff\x0cend", "\x00\x01 � ", "a" * 70_000, "word " * 3000, " lead and trail  ", "...!!??--==", " line para", "ss ß ẞ ǅ",
]


def test_token_counts_are_the_librarys(spark, vocabulary):
    rng = random.Random(6)
    bits = [t for t in ODD if t] + ["the", "House", "ung", "'s", ",", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice((" ", "\n", "", "  ")) + rng.choice(bits)[:40] for _ in range(30)) for _ in range(60)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = spark.createDataFrame([(i if i % 7 else None, t, "k", "p", "r") for i, t in enumerate(texts)], "doc_id long, text string, known string, piece string, row string")
    for head in (tokens.HEAD, 0):
        got = tokens.count_tokens(rows, vocabulary, limit=500, head=head).collect()
        wanted = [(i if i % 7 else None, len((t or "").encode()), n, n > 500) for i, (t, n) in enumerate(zip(texts, library(vocabulary, texts), strict=True))]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))
    assert tokens.count_tokens(rows.limit(0), vocabulary).count() == 0


def test_long_texts_are_cut_at_spaces(vocabulary):
    text = ("Long word's " * 5 + "\n<|endoftext|>. ") * 400 + "x" * 3000
    pieces = list(tokens.parts(text, 1000))
    assert "".join(pieces) == text and len(pieces) > 10 and all(p.startswith(" ") for p in pieces[1:])
    assert sum(library(vocabulary, pieces)) == library(vocabulary, [text])[0]


def test_tokenizers_that_keep_white_space_are_refused(spark):
    import public_tokenizers

    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="white space"):
        tokens.count_tokens(rows, public_tokenizers.path("byte_bpe_50k.json"))


# 13 phrases


def brute_phrases(pairs, least, top=2000, percent=100):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in pairs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts[lang].update(" ".join(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if a >= least and " " in p}
        gone = set()
        for p, a in candidates.items():
            w = p.split(" ")
            inside = {" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1)} - {p}
            gone |= {q for q in inside if 100 * a >= percent * candidates[q]}
        rows = []
        for p, a in candidates.items():
            if p not in gone:
                w = p.split(" ")
                cuts = [(c[" ".join(w[:k])], c[" ".join(w[k:])]) for k in range(1, len(w))]
                score, k = min((1000 * a * n[lang] // (x * y), k) for k, (x, y) in enumerate(cuts))
                rows.append((-score, -a, p.encode(), *cuts[k]))
        rows.sort()
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(rows[:top], 1)]
    return sorted(out)


def phrase_pairs():
    rng = random.Random(7)
    vocabulary = ["the", "The", "of", "é", "ÉT", "a\x00b", "naïve", "日本", *(f"w{i}" for i in range(25))]
    joins = [" ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "\x0b", ";", "! "]
    text = lambda n: "".join(rng.choice(vocabulary[: rng.choice((4, 33))]) + rng.choice(joins) for _ in range(n))
    pairs = [(rng.choice(("en", "fr", None, "und", "")), text(rng.randrange(0, 400))) for _ in range(60)]
    fixed = "on the other hand we find new york city in the state of new york"
    return [*pairs, ("en", None), ("en", ""), ("en", " \t\n"), *[("en", fixed)] * 9, ("fr", text(20000)), ("de", "one two. three"), *[("de", "ja ja ja ja ja ja ja")] * 3]


def phrase_table(spark, pairs):
    return spark.createDataFrame([(lang, text, "r", 1, "s") for lang, text in pairs], "lang string, text string, phrase string, rank int, score string")


@pytest.mark.parametrize("least, top, percent", [(4, 2000, 100), (1, 30, 100), (20, 5, 60), (300, 2000, 100)])
def test_phrases_are_those_of_all_counts(spark, least, top, percent):
    pairs = phrase_pairs()
    got = phrases.collocations(phrase_table(spark, pairs), least=least, top=top, percent=percent).collect()
    assert sorted(map(tuple, got)) == brute_phrases(pairs, least, top, percent)


def test_phrases_of_crowded_sketches_are_the_same(spark, monkeypatch):
    """A sketch too narrow for what it counts lets rare phrases through; the result is the same."""
    monkeypatch.setattr(phrases, "MIN_BITS", 16)
    monkeypatch.setattr(phrases, "MAX_BITS", 16)
    real = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = phrases.collocations(phrase_table(spark, real), least=6).collect()
    assert sorted(map(tuple, got)) == brute_phrases(real, 6)


def test_sieves_hold_back_rare_phrases_and_no_others(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("lang", "text").where("octet_length(text) > 0")
    sieve = phrases._sieve(base, 1 << 20, None, 5, 50)
    batch = pa.RecordBatch.from_pandas(base.toPandas(), preserve_index=False)
    counts, seen, kept = Counter(), 0, 0
    for part in phrases._parts(batch, 2):
        counts.update(part.key[2][part.whole[2]].tolist())
    keys = np.array(list(counts), np.uint64)
    passed = dict(zip(counts, sieve.passes(keys), strict=True))
    assert all(passed[k] for k, n in counts.items() if n >= 50)
    kept, seen = sum(passed[k] for k, n in counts.items() if n < 25), sum(n < 25 for n in counts.values())
    assert kept < seen / 100


def test_long_texts_come_in_stretches_without_loss(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice(("a", "bb", "c c", "longer", "x" * 300)) + rng.choice((" ", "  ", ". ", "\t")) for _ in range(5000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en", "fr"], "text": ["short one", text, "a bb c c"]})

    def counted():
        total = Counter()
        for part in phrases._parts(batch, 5):
            for n in range(1, 6):
                total.update(part.key[n][part.whole[n]].tolist())
        return total

    whole = counted()
    monkeypatch.setattr(phrases, "PART", 700)
    assert counted() == whole and len(list(phrases._stretches(*__import__("scoreloom.llm.text", fromlist=["utf8"]).utf8(batch.column("text"))))) > 20


def test_scores_pass_64_bits(spark):
    """Counts whose products are beyond 64 bits."""
    big = 10**13
    row = spark.sql(f"select (1000 * cast({big} as decimal(19)) * cast({big * 3} as decimal(19))) div (cast({big} as decimal(19)) * cast({big + 1} as decimal(19))) as x").first()
    assert row["x"] == 1000 * big * big * 3 // (big * (big + 1))


def test_phrase_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    got = queries()["op13_phrase_mining"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(oracle_sql()["op13_phrase_mining"]).fetchall()) and got


def test_phrase_edges(spark):
    assert phrases.collocations(phrase_table(spark, [("en", "a b")]).limit(0)).count() == 0
    assert phrases.collocations(phrase_table(spark, [("en", None), (None, "")])).count() == 0
    with pytest.raises(ValueError, match="words"):
        phrases.collocations(phrase_table(spark, [("en", "a b")]), longest=6)


# 2 near duplicates, judged by row


def brute_keep_one(pairs, k, percent):
    """Rows that stay, as lists of the rows that are as good as one another."""
    sets = []
    for _, text in pairs:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset({tuple(w)} if w else ()))
    groups = {s: {s} for (d, _), s in zip(pairs, sets, strict=True) if s and d is not None}
    for a, b in itertools.combinations(list(groups), 2):
        if groups[a] is not groups[b] and 100 * len(a & b) >= percent * len(a | b):
            groups[a] |= groups[b]
            for s in groups[a]:
                groups[s] = groups[a]
    out = [[i] for i, ((d, _), s) in enumerate(zip(pairs, sets, strict=True)) if d is None or not s]
    for g in {id(g): g for g in groups.values()}.values():
        rows = [i for i, ((d, _), s) in enumerate(zip(pairs, sets, strict=True)) if d is not None and s in g]
        least = min(pairs[i][0] for i in rows)
        out.append([i for i in rows if pairs[i][0] == least])
    return out


def test_one_row_of_each_group_stays_and_no_unlike_text_goes(spark):
    from scoreloom.llm import neardup

    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    a, b, c = words(80), words(80), words(80)
    pairs = [(3, a), (5, f"{a} more"), (5, " "), (5, b), (7, "a b c"), (7, None), (7, "a b c"), (9, c), (9, f"{c} x"), (9, c.upper()), (11, c), (None, a), (None, None), (4, b), (4, f"{b} y"), (20, ""), (20, ""), (21, "A b c"), (22, words(5000))]
    base = [words(60) for _ in range(15)]
    for _ in range(120):
        text = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            text[rng.randrange(60)] = "changed"
        pairs.append((rng.randrange(30, 70), rng.choice((" ".join(text), None, "", words(50)))))
    df = spark.createDataFrame([(d, t, i, "x", "y") for i, (d, t) in enumerate(pairs)], "doc_id long, text string, key_a int, n_shingles string, stays string")
    kept = neardup.keep_one(df, k=5, percent=80)
    assert kept.columns == df.columns
    found = sorted(r["key_a"] for r in kept.collect())
    wanted = brute_keep_one(pairs, 5, 80)
    assert len(found) == len(set(found)) == len(wanted)
    assert all(sum(i in found for i in rows) == 1 for rows in wanted)
    assert {2, 3, 5} - {3} <= set(found) and neardup.keep_one(df.limit(0)).count() == 0


# Hot keys


@pytest.fixture
def small_pieces(spark):
    """Any stage is large under these settings, and no side is small enough to be broadcast."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    [spark.conf.set(k, v) for k, v in wanted.items()]
    yield
    [spark.conf.unset(k) if v is None else spark.conf.set(k, v) for k, v in before.items()]


def recorded(monkeypatch, module):
    plans, real = [], module.materialise

    def materialise(df, tag):
        df.collect()
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, tag)

    monkeypatch.setattr(module, "materialise", materialise)
    return plans


def test_the_links_of_a_hub_are_split(spark, small_pieces, monkeypatch):
    from scoreloom.llm import components

    plans = recorded(monkeypatch, components)
    rng = random.Random(10)
    links = [(0, i) for i in range(1, 20_000)] + [(x, x + 1) for x in rng.sample(range(30_000, 90_000), 20_000)]
    found = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    assert all(found[i] == 0 for i in range(20_000)) and all(found[a] == found[b] for a, b in links)
    assert any(tag == "stars" and "skew=true" in plan for tag, plan in plans)


def test_a_value_that_many_texts_have_is_split(spark, small_pieces):
    from scoreloom.llm import secrets

    example = "token = ExAmPle0KeY1ThAtAllCopy2"
    rows = [(i, example if i % 3 == 0 else f"token = Own{i:08d}KeY{i:08d}", f"s{i % 9}") for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    found = secrets.find_secrets(df)
    assert sum(r["n_example"] for r in found.collect()) == 4000
    assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
