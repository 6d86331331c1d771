"""A bitmap of keys that joins with few matching rows use, so that the other rows are not shuffled.

A key sets one of 2^24 bits. The bitmap is a table of at most 2^18 rows, however many keys there are, and so may be
broadcast. With many keys more bits are set and fewer rows are held back; nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.storage import materialise

BITS = 24


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where ``df`` has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _place(key: Column) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key.cast("long")), F.lit(1 << BITS))
    return F.shiftright(at, 6).cast("int"), F.pmod(at, F.lit(64)).cast("int")


def key_bitmap(ids: DataFrame, key: str) -> DataFrame:
    word, bit = _place(F.col(key))
    bits = ids.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    return materialise(bits.groupBy("word").agg(F.bit_or("bit").alias("bits")), "bitmap")


def split(df: DataFrame, key: str, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be in the bitmap, and rows whose key certainly is not (null keys among them)."""
    word, bit = _place(F.col(key))
    at, has = fresh(df, "word", "bits")
    words = bitmap.select(F.col("word").alias(at), F.col("bits").alias(has))
    marked = df.join(F.broadcast(words), word == F.col(at), "left")  # 2^18 rows at most
    hit = F.coalesce(F.call_function("shiftright", F.col(has), bit).bitwiseAND(F.lit(1)) == 1, F.lit(False)) & F.col(key).isNotNull()
    return marked.where(hit).drop(at, has), marked.where(~hit).drop(at, has)


def drop_matching(df: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids(id_column)``; null keys stay."""
    maybe, rest = split(df, key, key_bitmap(ids, id_column))
    (other,) = fresh(df, "other")
    kept = maybe.join(ids.select(F.col(id_column).alias(other)), F.col(key).cast("long") == F.col(other), "left_anti")
    return rest.unionByName(kept)


def text_key(text: Column) -> Column:
    """A text's digest: its rows are told apart by it where a doc_id may be null, or shared by several texts."""
    return F.sha2(text.cast("string").cast("binary"), 256)


def by_text(df: DataFrame, texts: DataFrame, key: str, how: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose digest of ``text`` may be in ``texts(key, ...)``, joined with it (``how``: left or left_anti), and the
    rows whose digest certainly is not, which are not shuffled. Column names of ``texts`` other than the key must not be in
    ``df``."""
    digest, place, other = fresh(df, "digest", "place", "other")
    named = texts.withColumnRenamed(key, other)
    bitmap = key_bitmap(named.select(F.xxhash64(other).alias("place")), "place")
    keyed = df.withColumn(digest, text_key(F.col("text"))).withColumn(place, F.xxhash64(digest))
    maybe, rest = split(keyed, place, bitmap)
    found = maybe.join(named, maybe[digest] == F.col(other), how)
    return found.drop(digest, place, other), rest.drop(digest, place)
