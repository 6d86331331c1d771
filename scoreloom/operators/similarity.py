"""Similarity of an answer and a decision, on array functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import jaccard, once, seal, strip
from scoreloom.functions import fixed_values as V

HAN_RUN = "[\\u4e00-\\u9fa5]+"


def runs(c: Column, run: str = HAN_RUN) -> Column:
    """Distinct runs of a character class."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(run), 0))


def _both(x: Column, y: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of two arrays, each computed once."""
    return once(F.struct(x.alias("x"), y.alias("y")), lambda s: use(s["x"], s["y"]))


def _run_share(x: Column, y: Column) -> Column:
    return F.when((F.size(x) > 0) & (F.size(y) > 0), jaccard(x, y)).otherwise(0.0)


def run_similarity(a: Column, b: Column, run: str = HAN_RUN) -> Column:
    """Share of common runs; 0 when a side is null or has none."""
    return _both(runs(a, run), runs(b, run), _run_share)


def _present(c: Column, words: tuple[str, ...]) -> Column:
    """The words that occur, searched for in what lies within their range of characters: the rest is taken out in one pass."""
    low, high = (ord(f("".join(words))) for f in (min, max))
    held = F.regexp_replace(c, rf"[^\x{{{low:x}}}-\x{{{high:x}}}]+", chr(low - 1))
    return once(held, lambda text: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def key_phrases(c: Column, keywords: tuple[str, ...] = V.LEGAL_KEYWORDS, verbs: tuple[str, ...] = V.PHRASE_VERBS, stop: str = "，。") -> Column:
    """Keywords that occur, and the text from each verb to the next stop."""
    found = [F.regexp_extract_all(c, F.lit(f"{verb}[^{stop}]*"), 0) for verb in verbs]
    return F.array_distinct(F.concat(_present(c, keywords), *found))


def _phrase_share(x: Column, y: Column) -> Column:
    return F.coalesce(jaccard(x, y), F.lit(0.0))


def phrase_similarity(a: Column, b: Column) -> Column:
    return _both(key_phrases(a), key_phrases(b), _phrase_share)


def _outcome_share(x: Column, y: Column) -> Column:
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.5).when(F.arrays_overlap(x, y), 0.8).otherwise(0.3)


def outcome_consistency(a: Column, b: Column, words: tuple[str, ...] = V.OUTCOME_KEYWORDS) -> Column:
    return _both(_present(a, words), _present(b, words), _outcome_share)


def citations(c: Column, pattern: str = V.CITATION_PATTERN) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), 0))


def _basis_share(x: Column, y: Column) -> Column:
    none_x, none_y = F.size(x) == 0, F.size(y) == 0
    return F.when(none_x & none_y, 0.5).when(none_x | none_y, 0.2).otherwise(jaccard(x, y))


def basis_similarity(a: Column, b: Column, pattern: str = V.CITATION_PATTERN) -> Column:
    return _both(citations(a, pattern), citations(b, pattern), _basis_share)


def _structure(c: Column) -> Column:
    """Length and number of paragraphs."""
    return F.struct(F.length(c).alias("n"), F.size(F.filter(F.split(c, "\n"), lambda x: strip(x) != "")).alias("p"))


def _structure_share(x: Column, y: Column) -> Column:
    n, m, p, q = x["n"], y["n"], x["p"], y["p"]
    paragraphs = F.when((p == 0) | (q == 0), 0.5).otherwise(F.try_divide(F.least(p, q), F.greatest(p, q)))
    return F.when((n == 0) | (m == 0), 0.0).otherwise(0.6 * F.try_divide(F.least(n, m), F.greatest(n, m)) + 0.4 * paragraphs)


def structure_similarity(a: Column, b: Column) -> Column:
    """0.6 of the length ratio and 0.4 of the paragraph ratio."""
    return _both(_structure(a), _structure(b), _structure_share)


def similarity_metrics(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds the five shares (0..1), has_decision and phrase counts; all zero where a side is missing."""
    x, y = F.col(a), F.col(b)
    has = F.coalesce((x != "") & (y != ""), F.lit(False))
    parts = {"runs": runs, "phrases": key_phrases, "outcomes": lambda c: _present(c, V.OUTCOME_KEYWORDS), "laws": citations, "structure": _structure}
    found = {f"__{k}_{side}": F.when(has, of(c)) for k, of in parts.items() for side, c in (("x", x), ("y", y))}
    sealed = seal(df.withColumns(found | {"has_decision": has}), *found)
    at = {k: (F.col(f"__{k}_x"), F.col(f"__{k}_y")) for k in parts}
    metrics = {
        "overall_similarity": _run_share(*at["runs"]), "keyword_similarity": _phrase_share(*at["phrases"]), "result_consistency": _outcome_share(*at["outcomes"]),
        "legal_basis_similarity": _basis_share(*at["laws"]), "reasoning_similarity": _structure_share(*at["structure"]),
    }
    one, other = at["phrases"]
    counts = {"ai_keywords": F.size(one), "judge_keywords": F.size(other), "common_keywords": F.size(F.array_intersect(one, other))}
    out = {k: F.when(F.col("has_decision"), c).otherwise(0.0) for k, c in metrics.items()} | {k: F.when(F.col("has_decision"), c).otherwise(0).cast("long") for k, c in counts.items()}
    return sealed.withColumns(out).drop(*found)
