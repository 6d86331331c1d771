"""Small files beside Spark's tables: what tasks and the driver write one at a time, in the shared folder."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there: local, HDFS, S3 or GCS. ``s3a`` counts as ``s3``."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_file(uri: str, data: bytes) -> None:
    """Write a file that appears whole: under a name that readers pass over, then renamed."""
    system, path = store(uri)
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    hidden = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(data)
    system.move(hidden, path)


def read_files(uri: str) -> dict[str, bytes]:
    """Name and content of a folder's files, but for hidden ones; none where the folder is missing."""
    system, path = store(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    out = {}
    for f in found:
        if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
            with system.open_input_stream(f.path) as stream:
                out[f.base_name] = stream.read()
    return out


def names(uri: str) -> list[str]:
    """Names in a folder, sorted, but for hidden ones."""
    system, path = store(uri)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if not f.base_name.startswith(("_", ".")))


def read_file(uri: str) -> bytes:
    system, path = store(uri)
    with system.open_input_stream(path) as stream:
        return stream.read()


def remove_folder(uri: str) -> None:
    system, path = store(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def create_once(spark: SparkSession, uri: str, data: bytes) -> bool:
    """Create a file that no one else has created; False where it is there already. Readers never see a part of it. Locally by a hard
    link to a whole file, elsewhere by the file system's own exclusive creation."""
    system, path = store(uri) if uri.startswith("file:") or "://" not in uri else (None, uri)
    if isinstance(system, fs.LocalFileSystem):
        folder, name = path.rsplit("/", 1)
        os.makedirs(folder, exist_ok=True)
        whole = f"{folder}/_{name}.{uuid.uuid4().hex}"
        with open(whole, "xb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(whole, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(whole)
        return True
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(uri)
    try:
        out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, False)
    except Exception as failed:
        if "AlreadyExists" in str(failed) or "already exists" in str(failed):
            return False
        raise
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return True
