"""Folders on any file system that Spark reads, asked through its own client; only names, sizes and times reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

# fixed values: what marks a build's output, which holds no source
BUILD_FOLDER, BUILD_MANIFEST, CACHE_TAG = "target", "Cargo.toml", "CACHEDIR.TAG"


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    folder: bool
    modified: int
    size: int


def client(spark: SparkSession, path: str) -> tuple:
    """(the path, the client of its file system) of the JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = client(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, folder: str) -> list[Entry]:
    """What a folder holds, by name; nothing where there is no such folder."""
    target, fs = client(spark, folder or ".")
    if not fs.exists(target) or not fs.getFileStatus(target).isDirectory():
        return []
    found = [Entry(s.getPath().toString(), s.getPath().getName(), s.isDirectory(), s.getModificationTime(), s.getLen()) for s in fs.listStatus(target)]
    return sorted(found, key=lambda e: e.name)


def newest(spark: SparkSession, folders: Iterable[str], fits: Callable[[str], bool]) -> str | None:
    """The file last changed of those in the folders whose name fits; of files of one time the greatest path."""
    found = [(e.modified, e.path) for folder in folders for e in children(spark, folder) if not e.folder and fits(e.name)]
    return max(found)[1] if found else None


def walk(spark: SparkSession, root: str, configured: Iterable[str] = ()) -> Iterator[Entry]:
    """The files below a root, folder by folder; folders that hold a build's output are not entered, the root always is.

    Such a folder stands under its usual name beside a manifest, or holds a cache tag, or is one of ``configured``.  The
    usual name alone says nothing: a module may have it.
    """
    outputs = {client(spark, c)[1].makeQualified(client(spark, c)[0]).toString() for c in configured}
    open_ = [(root, True)]
    while open_:
        folder, first = open_.pop()
        inside = children(spark, folder)
        files = {e.name for e in inside if not e.folder}
        if CACHE_TAG in files and not first:
            continue
        yield from (e for e in inside if not e.folder)
        open_ += [(e.path, False) for e in inside if e.folder and e.path not in outputs and not (e.name == BUILD_FOLDER and BUILD_MANIFEST in files)]


def write_whole(spark: SparkSession, path: str, lines: Iterable[str], block: int = 1 << 20) -> None:
    """A file that appears whole: written beside its place, a block of lines at a time, and then renamed."""
    target, fs = client(spark, path)
    part, _ = client(spark, path + ".part")
    out = fs.create(part, True)
    held: list[str] = []
    size = 0
    try:
        for line in lines:
            held.append(line)
            size += len(line)
            if size >= block:
                out.write(bytearray("".join(held).encode()))
                held, size = [], 0
        out.write(bytearray("".join(held).encode()))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be replaced")
