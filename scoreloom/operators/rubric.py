"""Judge text to scores: parsing, caps, flags, penalties, grades. All built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import contains_any, seal, strip
from scoreloom.functions import fixed_values as V

D = ("d1", "d2", "d3", "d4", "d5")


def raw_number(text: Column, dimension: str, strict: bool = False) -> Column:
    """The dimension's number as text, or null. A section without one borrows that of the next section; ``strict`` stops
    at the next bracket instead."""
    gap = "[^【]*?" if strict else ".*?"
    forms = (rf"【{dimension}】{gap}得分[：:]\s*(\d+)", rf"{dimension}{gap}得分[：:]\s*(\d+)", rf"【{dimension}】{gap}(\d+)\s*分", rf"{dimension}{gap}(\d+)\s*分")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, "(?sU)" + p, 1), F.lit("")) for p in forms])


def dimension_scores(df: DataFrame, text: str = "judge_text", strict: bool = False) -> DataFrame:
    """Adds d1..d5, clamped to 0..4. Without any match d1 is the first digit 0-4 that stands alone, the others 0. Numbers
    are found in one projection and used in the next, so that no text is searched twice for one."""
    t = F.col(text)
    found = df.withColumns({f"__{d}": raw_number(t, name, strict) for d, name in zip(D, V.DIMENSIONS, strict=True)})
    lone = F.nullif(F.regexp_extract(t, r"(?U)\b([0-4])\b", 1), F.lit(""))
    scores = {d: F.least(F.lit(4.0), F.greatest(F.lit(0.0), F.coalesce(F.col(f"__{d}"), lone if d == "d1" else F.lit("0"), F.lit("0")).try_cast("double"))) for d in D}
    return found.withColumns(scores).drop(*[f"__{d}" for d in D])


def threshold_caps(df: DataFrame) -> DataFrame:
    """d1 = 0 caps d2 and d5 at 1; d4 <= 1 caps d5 at 2."""
    first = F.col("d1") == 0
    d5 = F.when(first, F.least("d5", F.lit(1.0))).otherwise(F.col("d5"))
    return df.withColumns({"d2": F.when(first, F.least("d2", F.lit(1.0))).otherwise(F.col("d2")), "d5": F.when(F.col("d4") <= 1, F.least(d5, F.lit(2.0))).otherwise(d5)})


def flag_section(text: Column) -> Column:
    """Text after the flag heading up to the next one; null if there is nothing to report."""
    section = strip(F.regexp_extract(text, r"(?sU)【错误标记】[^：:]*[：:]\s*(.*?)(?=\n【|\z)", 1))
    return F.when(~section.isin(*V.NO_FLAGS), section)


def severity_text(section: Column, severity: str) -> Column:
    """One severity's part of the flag section. A moderate part ends at a major one only."""
    stops = {V.MINOR: (V.MODERATE, V.MAJOR), V.MODERATE: (V.MAJOR,), V.MAJOR: (V.MINOR, V.MODERATE)}[severity]
    head = rf"-?\s*\*?\*?\s*{severity}\*?\*?\s*[：:]\s*"
    return strip(F.regexp_extract(section, rf"(?sU){head}(.*?)(?=\n\s*-?\s*\*?\*?\s*(?:{'|'.join(stops)})|\z)", 1))


def flag_items(part: Column, severity: str) -> Column:
    """A short part is one item; a long one is split at full stops and semicolons."""
    def none(x: Column) -> Column:
        return x.startswith("无") if severity == V.MAJOR else x.isin(*V.NO_ITEM)

    pieces = F.filter(F.transform(F.split(part, "[。；;]"), strip), lambda x: (F.length(x) > 10) & ~none(x))
    nothing = F.array().cast("array<string>")
    return F.when(part.isNull() | (part == "") | none(part), nothing).when(F.length(part) < 200, F.array(part)).otherwise(pieces)


SEVERITIES = (("minor", V.MINOR), ("moderate", V.MODERATE), ("major", V.MAJOR))


def error_flags(df: DataFrame, text: str = "judge_text") -> DataFrame:
    """Adds the item arrays minor, moderate, major: the section first, its parts next, their items last."""
    parts = df.withColumn("__section", flag_section(F.col(text))).withColumns({f"__{n}": severity_text(F.col("__section"), s) for n, s in SEVERITIES})
    return parts.withColumns({n: flag_items(F.col(f"__{n}"), s) for n, s in SEVERITIES}).drop("__section", *[f"__{n}" for n, _ in SEVERITIES])


def kept_hundredths() -> Column:
    """What the penalty leaves of a score, in hundredths: at least 20."""
    lost = 50 * F.least(F.size("major"), F.lit(2)) + 15 * F.least(F.size("moderate"), F.lit(2)) + 3 * F.least(F.size("minor"), F.lit(3))
    return 100 - F.least(lost, F.lit(80))


def apply_penalties(df: DataFrame) -> DataFrame:
    """Scales d1..d5 by the penalty, then the breakers for blaming and for made-up facts. Scores stay in hundredths
    of a point (e1..e5, whole numbers) next to d1..d5, so that totals are exact."""
    kept, said = kept_hundredths(), F.concat_ws("; ", "major")
    blame = contains_any(said, V.BLAME_WORDS) & ~contains_any(said, V.NEGATIONS)
    made_up = contains_any(said, V.FABRICATION_WORDS)
    e = {d: (F.col(d).cast("int") * kept).cast("long") for d in D}

    def capped(when: Column, c: Column, most: int) -> Column:
        return F.when(when, F.least(c, F.lit(most).cast("long"))).otherwise(c)

    e["d3"], e["d5"] = capped(blame, e["d3"], 100), capped(blame, e["d5"], 100)
    e["d4"], e["d2"], e["d1"] = capped(made_up, e["d4"], 0), capped(made_up, e["d2"], 100), capped(made_up, e["d1"], 100)
    df = df.withColumns({d.replace("d", "e"): c for d, c in e.items()})
    return df.withColumns({d: F.col(d.replace("d", "e")) / 100.0 for d in D})


def totals(df: DataFrame) -> DataFrame:
    """Adds total_h (hundredths), total, pct and grade."""
    df = df.withColumn("total_h", F.col("e1") + F.col("e2") + F.col("e3") + F.col("e4") + F.col("e5"))
    grade = F.when(F.col("total_h") >= 1600, V.GRADES[0]).when(F.col("total_h") >= 1100, V.GRADES[1]).when(F.col("total_h") >= 600, V.GRADES[2]).otherwise(V.GRADES[3])
    return df.withColumns({"total": F.col("total_h") / 100.0, "pct": F.col("total_h") * 5 / 100.0, "grade": grade})


def flag_summary() -> Column:
    """``minor: a; b; moderate: ...`` in fixed order; blank without flags."""
    parts = [F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, "; "))) for c, name in (("minor", V.MINOR), ("moderate", V.MODERATE), ("major", V.MAJOR))]
    return F.concat_ws("; ", *parts)


def evaluate(df: DataFrame, text: str = "judge_text", strict: bool = False) -> DataFrame:
    """Judge text to the flat score row: d1..d5, total, pct, grade, item arrays and the flag summary."""
    parsed = seal(error_flags(dimension_scores(df, text, strict), text), *D, "minor", "moderate", "major")
    scored = totals(apply_penalties(threshold_caps(parsed)))
    return scored.withColumn("error_flag", F.nullif(flag_summary(), F.lit("")))


def flatten_errors(df: DataFrame) -> DataFrame:
    """Item arrays as joined text, null where there is none."""
    return df.withColumns({c: F.nullif(F.array_join(c, "; "), F.lit("")) for c in ("minor", "moderate", "major")})


def with_failures(grid: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Every asked question; one without a result gets total 0 and the failure grade, its dimensions stay null."""
    joined = grid.join(results.withColumn("done", F.lit(True)), keys, "left")
    return joined.withColumns({
        "total": F.coalesce("total", F.lit(0.0)), "pct": F.coalesce("pct", F.lit(0.0)),
        "grade": F.coalesce("grade", F.lit(V.FAILED_GRADE)), "failed": F.col("done").isNull(),
    }).drop("done")
