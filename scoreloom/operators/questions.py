"""Questions, extracted evidence, prompts and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import strip


def parse_questions(c: Column, n: int = 5, safe: bool = False) -> Column:
    """First ``n`` non-blank lines without what stands up to the first '.' and then '、'. ``safe`` takes off a leading
    number only, so that text with a dot stays whole."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    if safe:
        bare = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^\d+\s*[.、．)]\s*", "")))
    else:
        bare = F.transform(lines, lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"(?s)^[^.]*\.", ""), "(?s)^[^、]*、", "")))
    return F.slice(bare, 1, n)


def question_rows(df: DataFrame, text: str, keys: list[str], n: int = 5) -> DataFrame:
    """A row for each question with its 1-based number."""
    return df.select(*keys, F.posexplode(parse_questions(F.col(text), n)).alias("p", "question")).select(*keys, (F.col("p") + 1).alias("q_no"), "question")


def is_verbatim(extracted: Column, decision: Column) -> Column:
    return F.contains(decision, extracted)


def best_passage(extracted: Column, source: Column, least: int = 20, share: float = 0.3, reach: int = 200, keyword: str = r"[一-龥]{2,}|\d+", stops: str = "[。；\n]") -> Column:
    """The source's text around the sentence that holds most of the extract's keywords; the extract itself when it is
    short, has no keyword, or no sentence holds more than ``share`` of them. The first of equals wins."""
    keys = F.regexp_extract_all(extracted, F.lit(keyword), 0)
    sentences = F.filter(F.split(source, stops), lambda s: F.length(strip(s)) >= least)
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.filter(keys, lambda k: F.contains(s, k))).alias("hits"), (-i).alias("order"), strip(s).alias("sentence")))
    best = F.array_max(F.transform(scored, lambda x: F.struct(x["hits"], x["order"], x["sentence"])))
    good = F.try_divide(best["hits"], F.size(keys)) > share
    at = F.position(best["sentence"], source)
    start = F.greatest(at - 1 - reach, F.lit(0))
    passage = strip(F.substring(source, start + 1, at - 1 + F.length(best["sentence"]) + reach - start))
    usable = (F.length(extracted) >= least) & (F.size(keys) > 0) & good
    return F.when(usable & (at > 0), passage).when(usable, best["sentence"]).otherwise(extracted)


def context(c: Column, has_decision: Column) -> Column:
    """The part of a text that goes into a prompt."""
    return F.when(has_decision, F.left(c, F.lit(2000))).otherwise(F.left(c, F.lit(3000)))


def prompt(template: str, **columns: Column) -> Column:
    """``template`` with each ``{name}`` replaced by its column; null is blank."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


_REPLY = "choices array<struct<message: struct<content: string, reasoning_content: string, thinking: string>, reasoning_content: string>>, reasoning_content string"


def parse_reply(c: Column) -> tuple[Column, Column]:
    """Answer and thinking of a chat response in JSON; thinking may stand in three places."""
    reply = F.from_json(c, _REPLY)
    first = F.get(reply["choices"], F.lit(0))
    return first["message"]["content"], F.coalesce(first["message"]["reasoning_content"], first["message"]["thinking"], first["reasoning_content"], reply["reasoning_content"])


def pair_by_index(df: DataFrame, keys: list[str], *arrays: str) -> DataFrame:
    """Arrays side by side, a row for each index that all of them have."""
    shortest = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    zipped = F.slice(F.arrays_zip(*arrays), F.lit(1), shortest)
    return df.select(*keys, F.posexplode(zipped).alias("idx", "z")).select(*keys, (F.col("idx") + 1).alias("idx"), "z.*")
