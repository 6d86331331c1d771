"""Column helpers shared by all operators."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = "[\\u4e00-\\u9fa5]"
#: Blanks of all scripts, and the separators of ASCII.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without leading and trailing blanks of any script."""
    return F.btrim(c, F.lit(BLANKS))


def null_if_blank(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """One search for all words, so that ``c`` is not computed once for each."""
    return c.rlike("|".join(map(re.escape, words)))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    found = F.regexp_extract(c, pattern, group)
    return F.when(c.rlike(pattern), found)


def find(c: Column, pattern: str) -> Column:
    """0-based start of the first match, or null."""
    return F.nullif(F.regexp_instr(c, F.lit(pattern)), F.lit(0)) - 1


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def last_index(c: Column, literal: str) -> Column:
    """0-based start of the last occurrence of ``literal``, or -1."""
    at = F.locate(literal[::-1], F.reverse(c))
    return F.when(at > 0, F.length(c) - at - len(literal) + 1).otherwise(-1)


def replace_all(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Regex rules one after another; classes are those of Unicode."""
    return reduce(lambda x, rule: F.regexp_replace(x, "(?U)" + rule[0], rule[1]), rules, c)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``c``, which is computed once a row however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def seal(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with ``columns`` generated as one struct: filters and projections above use what was computed and do not
    repeat how, which for parsed text would search it again for each use."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*columns))))
