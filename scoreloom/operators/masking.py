"""De-identification: ordered rule cascades. Rules are data and can be replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.functions import replace_all

KEPT_TOKENS = frozenset(V.LEGAL_TERMS + V.ROLE_TERMS)


#: Stands for a stretch that was taken out, and for itself where a text holds it.
_GAP, _GAP_ESCAPE = "\x03", "\x04"
_STRETCH = f"(?U)([^{V.MASK_CHARACTERS}])([^{V.MASK_ANCHORS}]{{6,}}[^{V.MASK_CHARACTERS}])"


def _condensed(c: Column, rules: Callable[[Column], Column]) -> Column:
    """``rules`` of ``c``, by what of it they can match. Between two anchors, no match goes past a character that rules don't hold: from
    the first such, at which a match before it may look, to the last, a stretch is taken out and put back when the rules are done."""
    safe = F.replace(F.replace(c, F.lit(_GAP_ESCAPE), F.lit(_GAP_ESCAPE + "b")), F.lit(_GAP), F.lit(_GAP_ESCAPE + "a"))
    masked = F.split(rules(F.regexp_replace(safe, _STRETCH, "$1" + _GAP)), _GAP)
    whole = F.zip_with(masked, F.regexp_extract_all(safe, F.lit(_STRETCH), 2), lambda kept, out: F.concat(kept, F.coalesce(out, F.lit(""))))
    return F.replace(F.replace(F.array_join(whole, ""), F.lit(_GAP_ESCAPE + "a"), F.lit(_GAP)), F.lit(_GAP_ESCAPE + "b"), F.lit(_GAP_ESCAPE))


def mask_sensitive(c: Column) -> Column:
    return _condensed(c, lambda x: replace_all(x, V.SENSITIVE_RULES))


def mask_dates(c: Column) -> Column:
    return _condensed(c, lambda x: replace_all(x, V.DATE_RULES))


def mask_locations(c: Column) -> Column:
    return _condensed(c, lambda x: replace_all(x, V.LOCATION_RULES))


def mask_role_names(c: Column) -> Column:
    return _condensed(c, lambda x: replace_all(x, V.NAME_RULES))


def correct(c: Column) -> Column:
    for wrong, right in V.CORRECTIONS:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


#: Stands around matches, and for itself where a text holds it.
_MARK, _ESCAPE = "\x01", "\x02"


def replace_matches(c: Column, pattern: str, decide: Callable[[Column], Column]) -> Column:
    """``c`` with each match of ``pattern`` replaced by ``decide`` of it. Matches are marked in one pass over the text, which is then cut at the
    marks: every second piece is a match. Blanks in the pattern are those of all scripts."""
    safe = F.replace(F.replace(c, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_MARK), F.lit(_ESCAPE + "a"))
    marked = F.regexp_replace(safe, "(?U)" + pattern.replace(r"\s", r"\s\x1c-\x1f"), _MARK + "$0" + _MARK)
    pieces = F.transform(F.split(marked, _MARK), lambda p, i: F.when(i % 2 == 0, p).otherwise(decide(p)))
    joined = F.array_join(pieces, "")
    return F.replace(F.replace(joined, F.lit(_ESCAPE + "a"), F.lit(_MARK)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE))


def mask_gendered_names(c: Column) -> Column:
    """A name with its gender; terms of law stay."""

    def decide(found: Column) -> Column:
        name = F.regexp_replace(found, "[,，]?[女男]$", "")
        return F.when(name.isin(*V.LEGAL_TERMS), found).when(F.contains(found, F.lit("女")), "某女").otherwise("某男")

    return replace_matches(c, V.GENDER_NAME_PATTERN, decide)


def mask_standalone_names(c: Column) -> Column:
    """Two to four Han characters before a delimiter, unless masked already or a known term. What is
    kept is consumed as well, so this can't be a look-ahead alone."""
    return replace_matches(c, V.STANDALONE_NAME_PATTERN, lambda found: F.when(F.contains(found, F.lit("某")) | found.isin(*sorted(KEPT_TOKENS)), found).otherwise("某"))


def mask(c: Column) -> Column:
    """The whole cascade: numbers, dates, places, names, lone names, corrections. Null and blank stay."""

    def rules(x: Column) -> Column:
        places = replace_all(x, (*V.SENSITIVE_RULES, *V.DATE_RULES, *V.LOCATION_RULES))
        return mask_standalone_names(replace_all(mask_gendered_names(places), V.NAME_RULES))

    return correct(_condensed(c, rules))


def mask_cases(cases: DataFrame, columns: tuple[str, ...] = ("case_text", "judge_decision")) -> DataFrame:
    """Adds ``<column>_masked`` for each column."""
    return cases.withColumns({f"{c}_masked": mask(F.col(c)) for c in columns})


def clean_reply(c: Column, lead: str = "脱敏后的文本：", tail: str = "原始文本") -> Column:
    """A remote masker's reply without what it says before and after the text."""
    at = F.instr(c, lead)
    return F.btrim(F.substring_index(F.btrim(F.when(at > 0, F.substring(c, at + len(lead), F.length(c))).otherwise(c)), tail, 1))


def choose_masked(remote: Column, c: Column) -> Column:
    """The remote masker's text, or the rules' where it has none."""
    return F.coalesce(F.nullif(F.btrim(remote), F.lit("")), c)
