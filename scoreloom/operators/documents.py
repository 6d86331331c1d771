"""Case documents: cleaning, splitting into facts, reasoning and decision, dates."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import HAN, find, first_match, last_index, once, strip
from scoreloom.functions import fixed_values as V

#: Entities that are decoded without Python; ``&amp;`` goes last.
COMMON_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def unescape_all(c: Column) -> Column:
    """Every HTML entity, by the full table."""
    return F.pandas_udf(_unescape, "string")(c)


def clean_text(c: Column, full_entities: bool = False) -> Column:
    """Without tags, entities, control characters, repeated blanks and blank lines; null is blank."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")
    if full_entities:
        text = unescape_all(text)
    else:
        for entity, plain in COMMON_ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.regexp_replace(text, r"[^\t\n\r\x20-\x7e\x{a0}-\x{10ffff}]", "")
    text = F.regexp_replace(text, "[ \\t]+", " ")
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.array_join(lines, "\n")


def clean_cell(c: Column) -> Column:
    """Without the control characters that sheets don't take."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def _from(c: Column, at: Column) -> Column:
    return F.substring(c, at + 1, F.length(c))


def _upto(c: Column, at: Column) -> Column:
    return F.when(at.isNull(), c).otherwise(F.left(c, at))


def split_document(df: DataFrame, text: str = "content") -> DataFrame:
    """Adds facts, reasoning, decision_part, judge_decision: the reasoning begins at the first marker of the first
    pattern that occurs, the decision after the earliest decision marker, facts end where either begins."""
    c = F.col(text)
    df = df.withColumns({"r_at": F.coalesce(*[find(c, p) for p in V.REASONING_PATTERNS]), "d_at": find(c, V.DECISION_PATTERN)})
    rest = _from(c, F.col("r_at"))
    reasoning = F.when(F.col("r_at").isNotNull(), strip(_upto(rest, F.coalesce(find(rest, V.REASONING_END), find(rest, V.NEXT_DECISION)))))
    df = df.withColumn("d_end", F.col("d_at") + F.length(F.regexp_extract(c, V.DECISION_PATTERN, 0)))
    after = _from(c, F.col("d_end"))
    decision = F.when(F.col("d_at").isNotNull(), strip(_upto(after, F.coalesce(find(after, V.DECISION_END_FINAL), find(after, V.DECISION_END_NAMES)))))
    df = df.withColumns({"reasoning": F.nullif(reasoning, F.lit("")), "decision_part": F.nullif(decision, F.lit(""))})
    both = F.when(F.col("r_at") < F.col("d_end"), F.concat_ws("\n\n", "reasoning", "decision_part")).otherwise(F.col("decision_part"))
    joined = F.when(F.col("reasoning").isNotNull() & F.col("decision_part").isNotNull(), both).otherwise(F.coalesce("reasoning", "decision_part", F.lit("")))
    facts = strip(_upto(c, F.least("r_at", "d_end")))
    df = df.withColumns({"judge_decision": strip(joined), "facts": facts})
    left = F.greatest(*[last_index(F.col("facts"), m) for m in V.RESIDUAL_MARKERS])
    return df.withColumn("facts", F.when(left >= 0, strip(F.left("facts", left))).otherwise(F.col("facts"))).drop("r_at", "d_at", "d_end")


_MONTHS = {"十": 10, "十一": 11, "十二": 12} | {d: i + 1 for i, d in enumerate("一二三四五六七八九")}


def _day_names() -> dict[str, int]:
    digits = "一二三四五六七八九"
    names = {d: i + 1 for i, d in enumerate(digits)} | {"十": 10, "二十": 20, "三十": 30}
    names |= {"十" + d: 11 + i for i, d in enumerate(digits)} | {"二十" + d: 21 + i for i, d in enumerate(digits)}
    return names | {"三十一": 31}


def _two(names: dict[str, int], c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in (pair[0], f"{pair[1]:02d}")])
    return F.coalesce(F.try_element_at(table, c), F.lit("01"))


#: One test of a range at each place before the numerals are tried one by one.
_HAN_DATE = f"(?=[\u3007\u4e00-\u9fff]){V.HAN_DATE}"


def han_date(c: Column) -> Column:
    """The first date in Han numerals as yyyy-mm-dd; null without four year digits."""

    def written(found: Column) -> Column:
        part = [first_match(found, V.HAN_DATE, k) for k in (1, 2, 3)]
        year = F.replace(F.translate(part[0], "〇零一二三四五六七八九", "00123456789"), F.lit("十"), F.lit("10"))
        return F.when(F.length(year) == 4, F.concat_ws("-", year, _two(_MONTHS, part[1]), _two(_day_names(), part[2])))

    return once(F.regexp_extract(c, _HAN_DATE, 0), written)


def arabic_date(c: Column) -> Column:
    """The last date in digits as yyyy-mm-dd, or null."""

    def written(last: Column) -> Column:
        part = [F.regexp_extract(last, V.ARABIC_DATE, k) for k in (1, 2, 3)]
        return F.when(last.isNotNull(), F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")))

    return once(F.try_element_at(F.regexp_extract_all(c, F.lit(V.ARABIC_DATE), 0), F.lit(-1)), written)


def case_date(c: Column) -> Column:
    return F.coalesce(han_date(c), arabic_date(c))


def title_of(path: Column) -> Column:
    """File name without its extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def han_count(c: Column, n: int = 200) -> Column:
    return F.regexp_count(F.left(c, F.lit(n)), F.lit(HAN))
