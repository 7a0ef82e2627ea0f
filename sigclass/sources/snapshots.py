"""Snapshots of a stored table: a manifest per version, published by one rename.

A table is a folder of Parquet folders and files. Its manifests, ``_snapshots/<version>.json``,
name the entries that belong to each version; an entry may have side folders (a file index,
statistics) that appear and go with it. A writer writes its files first, where no snapshot names
them, and then commits: it reads the newest version, checks that what it removes is still there,
and renames a finished manifest to the next version's name, which fails if another writer was first
(then it tries again on that one's version). A reader resolves a version once and reads only its
entries: it sees all of a commit or nothing, and goes on reading its version whatever is
committed. Renames must not replace files, as on HDFS, ABFS and local folders.

The first commit takes in what the folder already holds. A table without manifests is read by
listing, as before. Manifests name one entry for each commit since the last compaction, so
compact (``tables.compact_packets_table``) before there are very many.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors.exceptions.captured import convert_exception
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

FOLDER = "_snapshots"
_LOCK = threading.Lock()  # renames of local folders are not exclusive between threads


class Conflict(RuntimeError):
    """Another commit removed what this one was to replace."""


@dataclass(frozen=True)
class Snapshot:
    """A version of a table: ``entries`` maps a name to {"data": [relative paths], "index": path or
    None, "stats": path or None, "rows": number or None}."""
    path: str
    version: int
    entries: dict = field(default_factory=dict)

    def data_paths(self, names: Iterable[str] | None = None) -> list[str]:
        names = self.entries if names is None else names
        return [f"{self.path}/{p}" for n in names for p in self.entries[n]["data"]]

    def side_paths(self, kind: str) -> list[str]:
        return [f"{self.path}/{e[kind]}" for e in self.entries.values() if e.get(kind)]

    def complete(self, kind: str) -> bool:
        """Has every entry this side folder?"""
        return bool(self.entries) and all(e.get(kind) for e in self.entries.values())


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what a folder holds; none if there is no such folder."""
    _, p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), bool(s.isDirectory())) for s in fs.listStatus(p))


def read_text(spark: SparkSession, path: str) -> str:
    jvm, p, fs = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file under another name and rename it; False if the name is taken."""
    jvm, p, fs = _hadoop(spark, path)
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(temporary, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        with _LOCK:
            context.rename(fs.makeQualified(temporary), fs.makeQualified(p), options)
        return True
    except Py4JJavaError as e:
        fs.delete(temporary, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise convert_exception(e.java_exception) from e


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n, _ in _names(spark, f"{path}/{FOLDER}") if n.endswith(".json"))


def newest_version(spark: SparkSession, path: str) -> int:
    """The number of the newest version (0: none): a listing, no manifest is read."""
    return max(_versions(spark, path.rstrip("/")), default=0)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """A version of the table (the newest one), or None if it has no manifests."""
    path = path.rstrip("/")
    version = version or newest_version(spark, path)
    if not version:
        return None
    found = json.loads(read_text(spark, f"{path}/{FOLDER}/{version:015d}.json"))
    return Snapshot(path, version, found["entries"])


def _taken_in(spark: SparkSession, path: str, but: set) -> dict:
    """The entries of a table that was written without manifests."""
    found = [n + ("/" if folder else "") for n, folder in _names(spark, path) if n[0] not in "_." and n not in but]
    files = [n for n in found if not n.endswith("/")]
    entries = {n[:-1]: {"data": [n[:-1]]} for n in found if n.endswith("/")}
    if files:
        entries["files"] = {"data": files}
    return entries


def commit(spark: SparkSession, path: str, add: dict | None = None, remove: Iterable[str] = (),
           attempts: int = 100, expected: int | None = None) -> Snapshot:
    """Publish a version with the entries ``add`` (name -> entry, whose files are all written) and without
    those in ``remove``.

    An added name that is already there is replaced: a micro-batch that is run again publishes the
    same batch. ``Conflict`` is raised if an entry to remove is gone, or if the newest version is not
    the ``expected`` one (for what was computed from a whole version)."""
    path, add, remove = path.rstrip("/"), dict(add or {}), set(remove)
    own = {p.split("/")[0] for e in add.values() for p in e["data"]}
    for _ in range(attempts):
        now = read_snapshot(spark, path)
        entries = dict(now.entries) if now else _taken_in(spark, path, own)
        if expected is not None and expected != (now.version if now else 0):
            raise Conflict(f"{path}: version {now.version if now else 0} is newer than {expected}")
        gone = remove - set(entries)
        if gone:
            raise Conflict(f"{path}: no longer there: {sorted(gone)[:5]}")
        entries = {n: e for n, e in entries.items() if n not in remove} | add
        version = (now.version if now else 0) + 1
        if publish_text(spark, f"{path}/{FOLDER}/{version:015d}.json", json.dumps({"entries": entries})):
            return Snapshot(path, version, entries)
    raise Conflict(f"{path}: {attempts} commits were overtaken")


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The files of the table's newest snapshot; without snapshots, all Parquet files under ``path``
    (root and every batch/version directory). Without a schema, the files' schemas are merged."""
    r = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true" if schema is None else "false")
    if schema is not None:
        r = r.schema(schema)
    snapshot = read_snapshot(spark, path)
    if snapshot is None:
        return r.parquet(path)
    if not snapshot.entries and schema is not None:
        return spark.createDataFrame([], schema)
    return r.parquet(*snapshot.data_paths())


def append(spark: SparkSession, df: DataFrame, path: str, name: str | None = None) -> Snapshot:
    """Add rows to a table as one commit. The files come to lie in the table's own folder."""
    path = path.rstrip("/")
    name = name or f"append_{uuid.uuid4().hex[:16]}"
    staging = f"{path}/_staging/{name}"
    df.write.mode("overwrite").parquet(staging)
    jvm, _, fs = _hadoop(spark, staging)
    data = []
    for i, part in enumerate(n for n, _ in _names(spark, staging) if n.endswith(".parquet")):
        data.append(f"{name}-{i:05d}.parquet")
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(f"{staging}/{part}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{data[-1]}")):
            raise OSError(f"cannot move {staging}/{part}")
    fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
    return commit(spark, path, {name: {"data": data}})
