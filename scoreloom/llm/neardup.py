"""Near-duplicate documents by HyperMinHash registers.

Each document's word shingles are hashed once. The top bits of a hash choose one of 128 buckets; a bucket
keeps its smallest remaining value in compressed form: the count of leading zeros and ten mantissa bits.
Bands of four registers (empty ones filled from others, by a fixed probing order) propose candidates; the
register agreement, corrected for chance collisions, rejects hopeless ones; all others are decided on
the full shingle sets.

No band bucket is expanded into pairs. Every member is tested against the bucket's first member, and the links found
give components. Buckets that still span several components are then searched exactly: members outside the main
component against all members whose sets are near enough in size, in blocks. A block sees registers first; only rows
with a pair that may be similar, is not linked yet, and shares no earlier band, bring their texts to it. It
gives out confirmed links, at most one for each row and component.

Rows with equal sets are one class, and all work is done on classes. Classes of one doc_id are linked, whatever their texts, where
documents are told apart by doc_id; where one row of each group is kept, texts alone count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scoreloom.llm import text as tx
from scoreloom.llm.components import connected_components
from scoreloom.llm.keyfilter import drop_matching, fresh, key_bitmap, split
from scoreloom.llm.storage import map_batches, materialise

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BAND = 4
#: Rows, and about how many shingles, of each side of a block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Standard deviations by which an estimate may fall short of the threshold before a pair is rejected.
SLACK = 6.0

#: What names a set.
KEY = ["n_shingles", "key_a", "key_b"]
_SIGNED = "row long, doc_id long, n_shingles long, key_a long, key_b long, registers binary"


def compress(values: np.ndarray) -> np.ndarray:
    """Registers (1 and up) of the 57-bit bucket minima: leading zeros, then mantissa bits."""
    v = (values >> np.uint64(4)).astype(np.uint64)
    bits = np.frexp(v.astype(np.float64))[1].astype(np.int64)
    keep = MANTISSA_BITS + 1
    up = np.clip(keep - bits, 0, 63).astype(np.uint64)
    down = np.clip(bits - keep, 0, 63).astype(np.uint64)
    mantissa = ((v << up) >> down) & np.uint64((1 << MANTISSA_BITS) - 1)
    return (1 + ((53 - bits) << MANTISSA_BITS) + mantissa.astype(np.int64)).astype(np.uint16)


def registers_of(shingles: np.ndarray) -> np.ndarray:
    """The 128 registers of a sorted distinct shingle set; 0 marks an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        out[bucket[first]] = compress(shingles[first] & np.uint64((1 << (64 - BUCKET_BITS)) - 1))
    return out


_PROBES = np.stack([np.random.Generator(np.random.PCG64(j)).permutation(BUCKETS) for j in range(BUCKETS)], 1)


def densify(registers: np.ndarray) -> np.ndarray:
    """Fill empty registers of each row from its others, bucket by bucket in a fixed probing order."""
    out = registers.copy()
    todo = np.flatnonzero((out == 0).any(1) & (registers != 0).any(1))
    for step in _PROBES:
        if not len(todo):
            break
        part, source = out[todo], registers[todo]
        out[todo] = np.where(part == 0, source[:, step], part)
        todo = todo[(out[todo] == 0).any(1)]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key a band for each row of densified registers."""
    packed = np.ascontiguousarray(registers).view(np.uint64)
    return tx.mix(packed ^ tx.mix(np.arange(1, packed.shape[1] + 1, dtype=np.uint64) << np.uint64(32))).view(np.int64)


def _chance() -> float:
    """Probability that two registers of different shingles agree."""
    return 2.0 ** -MANTISSA_BITS / 3 * 2


def passes(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows of registers may reach ``threshold``: agreement among the buckets that either side
    fills, less the expected chance collisions, within ``SLACK`` deviations."""
    used = np.maximum((left | right).astype(bool).sum(-1), 1)
    same = ((left == right) & (left != 0)).sum(-1)
    chance = _chance()
    estimate = (same / used - chance) / (1 - chance)
    return estimate >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / used) - 2.0 / used


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums over a shingle set, which name it together with its size."""
    if not len(shingles):
        return 0, 0
    return int(np.bitwise_xor.reduce(tx.mix(shingles))), int(np.add.reduce(tx.mix(~shingles)))


def _name_columns(names: list[tuple[int, int]]) -> list[pa.Array]:
    pair = np.array(names, np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))]


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, regs = [], [], []
            for _, sets in tx.shingle_sets(batch.column("text"), k):
                sizes += map(len, sets)
                names += map(set_name, sets)
                regs += (registers_of(s).tobytes() for s in sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), *_name_columns(names), pa.array(regs, pa.binary())],
                names=[x.split()[0] for x in _SIGNED.split(", ")],
            )

    return run


def _named(k: int, as_names: list[str] | None = None):
    """Adds the names of the texts' sets."""
    as_names = as_names or KEY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, part in tx.shingle_sets(batch.column("text"), k) for s in part]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(s) for s in sets], pa.int64()), *_name_columns([set_name(s) for s in sets])], names=[*batch.schema.names, *as_names])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    per = BUCKETS // BAND
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = band_keys(densify(_matrix(part.column("registers"))))
            ids, sizes = (np.repeat(part.column(c).to_numpy(), per) for c in ("rep", "n_shingles"))
            places = np.tile(np.arange(per, dtype=np.int16), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(places), pa.array(ids), pa.array(sizes)], names=["band", "place", "rep", "n_shingles"])


def _estimate(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = passes(_matrix(batch.column("ra")), _matrix(batch.column("rb")), threshold)
                yield batch.select(["a", "b", "n"]).filter(pa.array(ok))

    return run


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                left = [s for _, sets in tx.shingle_sets(part.column("ta"), k) for s in sets]
                right = [s for _, sets in tx.shingle_sets(part.column("tb"), k) for s in sets]
                for x, y in zip(left, right, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _open_pairs(regs: np.ndarray, sizes: np.ndarray, comps: np.ndarray, role: np.ndarray, place: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query row of a block, the other rows that may be similar, are not linked with it yet, and are not in an
    earlier band together with it."""
    before = band_keys(densify(regs))[:, :place]
    others = np.flatnonzero(~role)
    for q in np.flatnonzero(role):
        near = others[(comps[others] != comps[q]) & (100 * np.minimum(sizes[others], sizes[q]) >= percent * np.maximum(sizes[others], sizes[q]))]
        near = near[~(before[near] == before[q]).any(1)] if len(near) else near
        near = near[passes(regs[q][None, :], regs[near], percent / 100)] if len(near) else near
        if len(near):
            yield q, near


_BLOCK = ["band", "about", "q", "o"]
_WANTED = "band long, about int, q int, o int, place short, rep long, comp long, query boolean"


def _block_rows(percent: int):
    """The rows of a block that have such a pair."""

    def run(table: pa.Table) -> pa.Table:
        regs = _matrix(table.column("registers").combine_chunks())
        role = np.asarray(table.column("query").to_pylist(), bool)
        wanted = np.zeros(len(role), bool)
        for q, near in _open_pairs(regs, table.column("n_shingles").to_numpy(), table.column("comp").to_numpy(), role, table.column("place")[0].as_py(), percent):
            wanted[q] = True
            wanted[near] = True
        return table.select([x.split()[0] for x in _WANTED.split(", ")]).filter(pa.array(wanted))

    return run


def _block_links(k: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, comps = table.column("rep").to_numpy(), table.column("comp").to_numpy()
        role = np.asarray(table.column("query").to_pylist(), bool)
        sets = [s for _, part in tx.shingle_sets(table.column("text").combine_chunks(), k) for s in part]
        sizes = np.array([len(s) for s in sets])
        found = []
        for q, near in _open_pairs(np.stack([registers_of(s) for s in sets]), sizes, comps, role, table.column("place")[0].as_py(), percent):
            flat = np.concatenate([sets[i] for i in near])
            at = np.minimum(np.searchsorted(sets[q], flat), sizes[q] - 1)
            common = np.add.reduceat((sets[q][at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[near])[:-1])))
            linked = near[100 * common >= percent * (sizes[near] + sizes[q] - common)]
            for i in linked[np.unique(comps[linked], return_index=True)[1]]:
                found.append((min(ids[q], ids[i]), max(ids[q], ids[i])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _beside(pairs: DataFrame, table: DataFrame, value: str, left: str, right: str) -> DataFrame:
    """``pairs(a, b, n)`` with both ends' ``value``. An ``a`` with ``n`` partners is dealt to a task for each ``BLOCK`` of them."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    ends = table.select(F.col("rep").alias("a"), F.col(value).alias(left))
    heads = pairs.select("a", "n").distinct().join(ends, "a").select("a", "n", left, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int"))
    return dealt.join(table.select(F.col("rep").alias("b"), F.col(value).alias(right)), "b").join(heads, ["a", "n", "part"]).select("a", "b", "n", left, right)


def _texts(base: DataFrame, classes: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """``(rep, text)`` of the classes in ``reps(rep)``: a text of the class's smallest doc_id that has the class's set."""
    wanted = materialise(classes.select(*KEY, "rep", "owner").join(reps, "rep", "left_semi"), "wanted")
    maybe, _ = split(base, "doc_id", key_bitmap(wanted, "owner"))
    one = map_batches(maybe, _named(k), "doc_id long, text string, n_shingles long, key_a long, key_b long").groupBy("doc_id", *KEY).agg(F.min("text").alias("text"))
    return materialise(one.withColumnRenamed("doc_id", "owner").join(wanted, ["owner", *KEY]).select("rep", "text"), "texts")


def _shared_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of each doc_id that has several."""
    name = F.struct(*KEY)
    several = signed.groupBy("doc_id").agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low <> high").select("doc_id")
    several = materialise(several, "several")
    members = signed.select("doc_id", *KEY).join(several, "doc_id").distinct().join(classes.select(*KEY, "rep"), KEY)
    members = materialise(members.select("doc_id", "rep"), "members")
    least = materialise(members.groupBy("doc_id").agg(F.min("rep").alias("a")), "least")  # written, so that the join can split a doc_id
    return members.join(least, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))


def _crowded(reps: DataFrame) -> DataFrame:
    """``(band, place, pivot, n, rep, n_shingles)``: members of the bands that several classes share. Bands with the same members ask
    the same question: the first of them stays."""
    bands = map_batches(reps, _bands, "band long, place short, rep long, n_shingles long")
    hashes = F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(20,0)")).alias("y")
    crowded = bands.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("n"), F.first("place").alias("place"), *hashes).where("n > 1")
    crowded = crowded.groupBy("pivot", "n", "x", "y").agg(F.min(F.struct("place", "band")).alias("first")).select(F.col("first.band").alias("band"), "pivot", "n")
    return materialise(bands.join(materialise(crowded, "crowded"), "band"), "buckets")  # written, so that the join can split a crowded band


def _blocks(members: DataFrame, named: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Rows that need their texts, by block: in each bucket that spans several components, the members outside its pivot's
    component, as queries, against all members of like size. ``about`` counts sizes in steps that no link leaps."""
    mains = named.select(F.col("rep").alias("pivot"), F.col("component").alias("main"))
    step = max(float(np.log(100.0 / percent)) * (1 + 1e-9), 1e-3)
    placed = (
        members.where("n > 2").join(named, "rep", "left").join(mains, "pivot", "left")
        .select("band", "place", "pivot", "rep", "n_shingles", F.coalesce("component", "rep").alias("comp"), F.coalesce("main", "pivot").alias("main"))
        .withColumns({"about": F.floor(F.log("n_shingles") / F.lit(step)).cast("int"), "outside": F.col("comp") != F.col("main")})
    )
    placed = materialise(placed, "open")
    spans = placed.groupBy("band").agg(F.count("*").alias("n"), F.count_if("outside").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    spans = materialise(spans.where("(m > 1 or (m = 1 and n > 2)) and low <> high").select("band"), "spans")
    placed = placed.where("rep <> pivot").join(spans, "band")
    near = F.explode(F.sequence(F.col("about") - 1, F.col("about") + 1)).alias("near")
    counts = placed.groupBy("band", "about").agg(F.count("*").alias("n"), F.count_if("outside").alias("m"), F.max("n_shingles").alias("most"))
    counts = materialise(counts, "counts")
    around = counts.select("band", near, "n", "most").groupBy("band", F.col("near").alias("about")).agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    side = F.greatest(F.lit(8), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.col("most"))))
    grid = counts.where("m > 0").select("band", "about", "m").join(around, ["band", "about"])
    grid = materialise(grid.select("band", "about", F.ceil(F.col("n") / side).cast("int").alias("all_blocks"), F.ceil(F.col("m") / side).cast("int").alias("query_blocks")), "grid")
    placed = placed.join(reps.select("rep", "registers"), "rep").withColumn("h", F.xxhash64("rep"))
    row = ["place", "rep", "comp", "n_shingles", "registers"]
    queries = placed.where("outside").join(grid, ["band", "about"]).select(
        "band", "about", F.pmod("h", "query_blocks").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("o"), *row, F.lit(True).alias("query")
    )
    others = placed.select("band", near, "h", *row).withColumnRenamed("near", "about").join(grid, ["band", "about"]).select(
        "band", "about", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("q"), F.pmod("h", "all_blocks").cast("int").alias("o"), *row, F.lit(False).alias("query")
    )
    return materialise(queries.unionByName(others).groupBy(*_BLOCK).applyInArrow(_block_rows(percent), _WANTED), "block-rows")


def _grouped(docs: DataFrame, k: int, percent: int, shared_ids: bool) -> tuple[DataFrame, DataFrame]:
    """The documents' signatures, and each class with its component and the smallest doc_id that has it (``owner``)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(map_batches(base.withColumn("row", F.monotonically_increasing_id()), _sign(k), _SIGNED), "signed")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    # Equal sets are one class, named by its first row. Written, so that joins with it can split a large class.
    classes = filled.groupBy(*KEY).agg(F.min("row").alias("rep"), F.min("doc_id").alias("owner"), F.first("registers").alias("registers"))
    classes = materialise(classes, "classes")
    reps = classes.select("rep", "n_shingles", "registers")
    members = _crowded(reps)
    stars = materialise(members.where("rep <> pivot").groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b")).agg(F.max("n").alias("n")), "stars")
    estimated = map_batches(_beside(stars, reps, "registers", "ra", "rb"), _estimate(percent / 100), "a long, b long, n long")
    likely = materialise(estimated, "likely")
    texts = _texts(base, classes, likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), k)
    links = map_batches(_beside(likely, texts, "text", "ta", "tb"), _verify(k, percent), "a long, b long")
    links = materialise(links.unionByName(_shared_ids(filled, classes)) if shared_ids else links, "confirmed")
    found = materialise(connected_components(links), "components")

    blocks = _blocks(members, found.select(F.col("id").alias("rep"), "component"), reps, percent)
    texts = _texts(base, classes, blocks.select("rep").distinct(), k)
    more = materialise(blocks.join(texts, "rep").groupBy(*_BLOCK).applyInArrow(_block_links(k, percent), "a long, b long").distinct(), "more")
    if not more.isEmpty():
        found = materialise(connected_components(links.unionByName(more)), "components")

    labelled = classes.select(*KEY, "rep", "owner").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return signed, labelled.withColumn("component", F.coalesce("component", "rep"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text, ...)``.

    Two documents are linked when ``100 * intersection >= percent * union`` of their distinct ``k``-word
    shingles. ``component_id`` is the smallest doc_id reachable over links.

    Null and blank texts have the empty set and link with nothing. Texts under ``k`` words are one shingle. Very long
    texts are read whole. Rows that repeat a doc_id are linked, whatever their texts, unless blank: a blank row is a document
    without words and its own component, whatever other rows of its doc_id come to. A null doc_id links with
    nothing and is kept, with a null component. Ties: none, the smallest doc_id stands. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    signed, labelled = _grouped(docs, k, percent, shared_ids=True)
    labelled = materialise(labelled, "labelled")  # written, as the next, so that the join can split a large component
    least = materialise(labelled.groupBy("component").agg(F.min("owner").alias("component_id")), "least")
    labelled = materialise(labelled.join(least, "component").select(*KEY, "component_id"), "named-classes")
    result = signed.select("doc_id", *KEY).join(labelled, KEY, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: of the smallest doc_id in the group, and of several rows of that
    doc_id the first by a hash of the whole row, among those with the least set by name.

    What counts is the text of each row: rows that share a doc_id and have unlike texts are judged apart, and may all stay. Null
    doc_ids stay. Blank texts are near nothing and all stay, repeated or not; very long ones are read whole. An empty table
    gives an empty result. Other columns may have any names.
    """
    signed, labelled = _grouped(docs, k, percent, shared_ids=False)
    first = F.min(F.struct("owner", *KEY)).alias("first")
    chosen = labelled.groupBy("component").agg(first).select(F.col("first.owner").alias("doc_id"), *[F.col(f"first.{c}").alias(c) for c in KEY])
    chosen = materialise(chosen.withColumn("stays", F.lit(True)), "chosen")  # written, so that the join can split what many rows have
    rows = signed.where("doc_id is not null").select("doc_id", *KEY)
    rows = rows.join(chosen, ["doc_id", *KEY], "left").withColumn("stays", F.coalesce("stays", F.col("n_shingles") == 0))
    verdicts = materialise(rows, "verdicts")
    ids = verdicts.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("stays").alias("any"))
    ids = materialise(ids.where("n > 1 or not any"), "not-once")
    left = drop_matching(docs, "doc_id", ids.where("not any").select("doc_id"), "doc_id")
    bitmap = key_bitmap(ids.where("any"), "doc_id")  # doc_ids with several rows, of which some stay
    maybe, once = split(left, "doc_id", bitmap)
    size, *names = fresh(docs, *KEY)
    schema = StructType([*maybe.schema.fields, *(StructField(c, LongType()) for c in (size, *names))])
    named = map_batches(maybe, _named(k, [size, *names]), schema)
    stays, _ = split(verdicts.where("stays and n_shingles > 0").select("doc_id", *KEY).distinct(), "doc_id", bitmap)
    doc, *theirs = fresh(named, "doc", *KEY)
    stays = materialise(stays.select(F.col("doc_id").alias(doc), *[F.col(c).alias(t) for c, t in zip(KEY, theirs, strict=True)]), "stays")
    same = F.col("doc_id").cast("long") == F.col(doc)
    for mine, other in zip((size, *names), theirs, strict=True):
        same = same & (F.col(mine) == F.col(other))
    (row,) = fresh(docs, "row")
    whole = F.struct(*docs.columns)
    solid = named.where(F.col(size) > 0).join(stays, same).groupBy(doc, *theirs).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(row)).select(f"{row}.*")
    return once.unionByName(named.where(F.col(size) == 0).select(*docs.columns)).unionByName(solid)
