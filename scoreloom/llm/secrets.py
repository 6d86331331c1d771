"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds candidates: the base patterns, and long mixed tokens. The hashes of their secret
values are counted over the whole corpus by distinct repositories and owners. A value that ``WIDE`` or more owners hold
is a copied example, and so is one that several owners hold in ``WIDE_REPOSITORIES`` or more; any other looks live, in
however many repositories its one owner keeps it. Base spans stay in any case; mixed tokens become spans only if they
look live.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import text as tx
from scoreloom.llm.keyfilter import by_text, fresh, text_key
from scoreloom.llm.spans import Span, code_points, redact, sha256_hex
from scoreloom.llm.storage import map_batches, materialise

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token")
#: Owners, and repositories of two owners or more, from which on a value counts as a widely copied example.
WIDE, WIDE_REPOSITORIES = 3, 8
#: Shannon entropy, in bits a character, that a mixed token needs.
ENTROPY = 3.5

_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_MIXED = re.compile(rb"[A-Za-z0-9+/_-]{20,}={0,2}")

_FOUND = "doc_id long, spans array<struct<kind:int,start:int,end:int,value:long>>"


def _entropy(value: bytes) -> float:
    share = np.array(list(Counter(value).values())) / len(value)
    return float(-(share * np.log2(share)).sum())


def _looks_random(value: bytes) -> bool:
    kinds = (re.search(p, value) for p in (rb"[A-Z]", rb"[a-z]", rb"[0-9]"))
    return all(kinds) and _entropy(value) >= ENTROPY


def candidates(raw: bytes) -> list[tuple[Span, bytes]]:
    """Base spans in bytes with their secret values, by start then kind; then mixed tokens outside of them."""
    found = [(("assign", m.start(), m.end()), m[1]) for m in _ASSIGN.finditer(raw) if len(m[1]) >= 12]
    if b"AKIA" in raw:
        found += [(("access", m.start(), m.end()), m[0]) for m in _ACCESS.finditer(raw) if len(m[0]) >= 18]
    found += [(("hex", m.start(), m.end()), m[0]) for m in _HEX.finditer(raw)]
    found.sort(key=lambda x: (x[0][1], BASE.index(x[0][0])))
    mixed = [m for m in _MIXED.finditer(raw) if _looks_random(m[0])]
    if mixed:
        covered = np.zeros(len(raw), bool)
        for (_, a, b), _ in found:
            covered[a:b] = True
        found += [(("token", m.start(), m.end()), m[0]) for m in mixed if not covered[m.start() : m.end()].any()]
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64())]))
    for batch in batches:
        data, offsets = tx.utf8(batch.column("text"))
        rows, counts, digests = [], [], []
        for i in range(len(offsets) - 1):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            found = candidates(raw)
            points = code_points(raw, [s for s, _ in found])
            rows.append([(KINDS.index(k), a, b, xxhash.xxh3_64_intdigest(v) - (1 << 63)) for (k, a, b), (_, v) in zip(points, found, strict=True)])
            base = [s for s in points if s[0] != "token"]
            counts.append([sum(k == kind for k, _, _ in base) for kind in BASE])
            digests.append(sha256_hex(",".join(f"{k}:{a}:{b}" for k, a, b in base)))
        table = np.array(counts, np.int64).reshape(-1, len(BASE))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("repository"), batch.column("owner"), pa.array(rows, kind_type), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(BASE))), pa.array(digests, pa.string())],
            names=["row", "doc_id", "repository", "owner", "spans", *(f"n_{k}" for k in BASE), "base_sha256"],
        )


_SCANNED = "row long, doc_id long, repository string, owner string, spans array<struct<kind:int,start:int,end:int,value:long>>, n_assign long, n_access long, n_hex long, base_sha256 string"


def value_frequency(scanned: DataFrame) -> DataFrame:
    """``(value, n_owners, n_repositories, n_spans)``. Rows of one value, owner and repository are summed before
    and during the first shuffle, so a value in a third of all documents stays a few rows."""
    spans = scanned.select("repository", "owner", F.explode("spans.value").alias("value"))
    by_place = spans.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_place.groupBy("value", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n_spans"))


def judged_spans(docs: DataFrame, repository: Column, owner: Column, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The scan, a row for each document, and ``(row, judged)``: each document's spans with their owners. A string
    ``key``, if given, takes the place of doc_id in the scan."""
    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        (F.col("doc_id").cast("long") if key is None else key).alias("doc_id"),
        repository.cast("string").alias("repository"),
        owner.cast("string").alias("owner"),
        F.col("text").cast("string").alias("text"),
    )
    schema = _SCANNED if key is None else _SCANNED.replace("doc_id long", "doc_id string")
    scanned = materialise(map_batches(base, _scan, schema), "scanned")
    widely = (F.col("n_owners") >= WIDE) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= WIDE_REPOSITORIES))
    wide = materialise(value_frequency(scanned).where(widely).select("value", "n_owners"), "widely-held")  # written, so that the join can split a value
    spans = scanned.select("row", F.inline("spans"))
    judged = spans.join(wide, "value", "left").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", F.col("n_owners").isNull().alias("live")))).alias("judged")
    )  # one document's spans
    return scanned, judged


def _where(docs: DataFrame) -> tuple[Column, Column]:
    owner = F.col("source") if "source" in docs.columns else F.lit(None)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return F.concat_ws("/", owner, lang), owner


def find_secrets(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example)`` of every row of
    ``docs(doc_id, text, ...)``; ``repository`` and ``owner`` default to source/lang and source.

    Null and empty texts have no spans; very long ones are read whole. Null owners count as one owner. Repeated rows are
    searched alike, and count once for their owner; a null doc_id is passed through; spans that begin together go by kind; an
    empty table gives an empty result. Other columns are ignored.
    """
    places = _where(docs)
    scanned, judged = judged_spans(docs, places[0] if repository is None else repository, places[1] if owner is None else owner)
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.filter("judged", lambda s: (s["kind"] < len(BASE)) | s["live"])
    text = F.array_join(F.transform(shown, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    live = F.size(F.filter("judged", lambda s: s["live"])).cast("long")
    return scanned.join(judged, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(text, F.lit("")).alias("spans"),
        F.when(F.col("judged").isNull(), 0).otherwise(live).alias("n_live"),
        F.when(F.col("judged").isNull(), 0).otherwise(F.size("judged") - live).alias("n_example"),
    )


def _redacted(spans: str):
    """Texts with the ``spans`` column's spans replaced, without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist(), strict=True):
                texts.append(redact(text, [(KINDS[s["kind"]], s["start"], s["end"]) for s in found]) if text and found else text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).drop_columns([spans])

    return run


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every live-looking secret in ``text`` replaced by its kind, and ``n_chars`` to match; widely
    copied examples stay, and so do all rows. A null or repeated doc_id makes no difference, nor do the names of other
    columns; null and empty texts stay as they are, very long ones are searched whole; of spans that overlap the first, then
    the longest, is replaced; repeated rows fare alike; an empty table stays empty."""
    # A span's place follows from the text and whether it is live from the whole corpus, so rows are joined by their
    # texts: a doc_id may be null, or shared by several texts.
    scanned, judged = judged_spans(docs, *_where(docs), key=text_key(F.col("text")))
    live = F.filter("judged", lambda s: s["live"])
    (spans,) = fresh(docs, "live_spans")
    found = scanned.select("row", F.col("doc_id").alias("hit")).join(judged, "row").where(F.size(live) > 0)
    found = materialise(found.groupBy("hit").agg(F.first(live).alias(spans)), "live")
    marked, rest = by_text(docs, found, "hit", "left")
    clean = map_batches(marked, _redacted(spans), docs.schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rest.unionByName(clean)
