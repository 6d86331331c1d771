"""Tables of parts that several writers replace at once, without locks.

A part (a model, a day) is the folders of Parquet files that a manifest lists for it. Manifests are numbered; the highest is the table. A
writer first writes its rows where no manifest points, then creates the manifest of the next number. Only one writer can
create it. Whoever comes too late reads the newer one, puts its own parts into that, and tries the next number. So
writers of different parts both succeed, of two writers of one part the later one stands whole, and readers see one
version all the time.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scoreloom.sources import files


class Conflict(Exception):
    """Someone else has replaced a part since the version that the writer had read."""


@dataclass
class Manifest:
    """``parts``: the folders of each part. ``changed``: the version that last replaced it. ``done``: the last batch of each stream."""

    version: int = 0
    schema: str | None = None
    parts: dict[str, list[str]] = field(default_factory=dict)
    changed: dict[str, int] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)


_NULL = "\x00"


def _manifests(path: str) -> str:
    return f"{path}/manifests"


def manifest(path: str, version: int | None = None) -> Manifest:
    """The newest manifest, or that of a version; an empty one before the first."""
    found = files.names(_manifests(path))
    name = f"{version:012d}.json" if version is not None else (found[-1] if found else None)
    if name is None or version == 0:
        return Manifest()
    return Manifest(**json.loads(files.read_file(f"{_manifests(path)}/{name}")))


def read(spark: SparkSession, path: str, version: int | None = None, parts: list[str | None] | None = None) -> DataFrame | None:
    """The rows of a version, or of some of its parts; None for a table that no one has written."""
    held = manifest(path, version)
    if held.schema is None:
        return None
    schema = StructType.fromJson(json.loads(held.schema))
    wanted = held.parts if parts is None else {k: held.parts.get(k, []) for k in map(_key, parts)}
    folders = [f"{path}/{f}" for each in wanted.values() for f in each]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _key(part) -> str:
    return _NULL if part is None else str(part)


def write_parts(df: DataFrame, path: str, part: str) -> dict[str, list[str]]:
    """Writes ``df`` where no manifest points yet, a folder for each value of ``part``; returns these. A part's folder has as many files as
    tasks had rows of it."""
    folder = f"data/{uuid.uuid4().hex}"
    held = df.withColumn("__part", F.coalesce(F.col(part).cast("string"), F.lit(_NULL)))
    # Parts are named in the folder by a digest, which needs no escapes; the names are few, one for each part written.
    held.withColumn("__folder", F.sha2("__part", 256)).drop("__part").write.partitionBy("__folder").parquet(f"{path}/{folder}")
    named = {r["f"]: r["p"] for r in held.select(F.sha2("__part", 256).alias("f"), F.col("__part").alias("p")).distinct().toLocalIterator()}
    found = [x for x in files.names(f"{path}/{folder}") if x.startswith("__folder=")] or [f"__folder={f}" for f in named]
    return {named[x.removeprefix("__folder=")]: [f"{folder}/{x}"] for x in found}


def commit(
    spark: SparkSession,
    path: str,
    schema: StructType,
    parts: dict[str, list[str]],
    seen: int | None = None,
    batch: tuple[str, int] | None = None,
    attempts: int = 100,
    sleep: Callable[[float], None] = time.sleep,
) -> Manifest | None:
    """Creates the next manifest with these parts in place of those of the same name. ``seen``: the version that the new parts were made from;
    Conflict if one of them has been replaced since. ``batch``: a stream and its batch; None, and no change, where that batch
    or a later one is done."""
    for attempt in range(attempts):
        now = manifest(path)
        if batch is not None and now.done.get(batch[0], -1) >= batch[1]:
            return None
        if seen is not None and (late := sorted(k for k in parts if now.changed.get(k, 0) > seen)):
            raise Conflict(f"replaced since version {seen}: {', '.join(late)}")
        loose = StructType([StructField(f.name, f.dataType) for f in schema.fields])
        text = json.dumps(loose.jsonValue())
        if now.schema is not None and StructType.fromJson(json.loads(now.schema)).simpleString() != loose.simpleString():
            raise ValueError("the new rows' columns are not the table's")
        version = now.version + 1
        made = Manifest(version, text, now.parts | parts, now.changed | dict.fromkeys(parts, version), now.done | ({batch[0]: batch[1]} if batch else {}))
        if files.create_once(spark, f"{_manifests(path)}/{version:012d}.json", json.dumps(made.__dict__).encode()):
            return made
        sleep(random.random() * min(2.0, 0.01 * 2**attempt))
    raise Conflict(f"no manifest in {attempts} attempts")


def replace_parts(df: DataFrame, path: str, part: str, empty: list | None = None, **options) -> Manifest | None:
    """Replaces the parts that ``df`` has rows of, and leaves those in ``empty`` without rows. A null is a part of its own; a table without rows
    replaces nothing; all columns are kept."""
    found = write_parts(df, path, part)
    return commit(df.sparkSession, path, df.schema, dict.fromkeys(map(_key, empty or []), []) | found, **options)


def clean(path: str, keep: int = 10) -> int:
    """Removes folders that none of the last ``keep`` versions lists, and older manifests. Not while someone writes."""
    versions = files.names(_manifests(path))
    wanted = {f.split("/")[1] for v in versions[-keep:] for each in manifest(path, int(v.split(".")[0])).parts.values() for f in each}
    gone = [x for x in files.names(f"{path}/data") if x not in wanted]
    for x in gone:
        files.remove_folder(f"{path}/data/{x}")
    system, folder = files.store(_manifests(path))
    for v in versions[:-keep]:
        system.delete_file(f"{folder}/{v}")
    return len(gone)
