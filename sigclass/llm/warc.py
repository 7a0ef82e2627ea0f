"""WARC archives: one gzip member per record, written and read by Spark tasks.

Writing: each task writes its pages to one archive in the shared folder through
a file system of its URI; the manifest of the finished tasks (path and size) is a
table, so a task that is lost and run again leaves nothing that is read twice.

Reading: archives are cut into byte ranges, one task reads some of them. In its
range it looks for the gzip magic number; a candidate is a member only if its
header decodes and what it inflates begins like a WARC record, so bytes that
look alike inside a member do not count. A range owns the records that begin in
it and reads on past its end to finish the last one. Members follow each other without
gaps, so a member that begins as a WARC record and does not inflate to its end, and bytes
between members that belong to none, are damage: ``read_archives`` raises, or with
``strict=False`` passes over it, and ``damaged`` lists it.

Defined results: a null page is empty. Equal payloads of at least ``least`` bytes:
the row with the largest page_id is the response (rows that repeat that page_id
and payload all are), the others revisit it. Without a page_id at all in such a
group all its rows are responses. An empty table gives an empty archive list and
no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigclass.session import fresh_path, materialize, ship_package

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: Begin of a gzip member: magic number and deflate (fixed values of RFC 1952).
MAGIC = b"\x1f\x8b\x08"
#: Schemes of Spark's file systems that Arrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _file_system(path: str):
    """The file system of a path or URI and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(_arrow_uri(path))


def _arrow_uri(path: str) -> str:
    """A path or URI of Spark's file systems as Arrow names it."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    scheme, sep, rest = path.partition("://")
    if sep and scheme.startswith("wasb"):  # the same container by its other end point
        rest = rest.replace(".blob.", ".dfs.", 1)
    return SCHEMES.get(scheme, scheme) + sep + rest if sep else path


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the response's HTTP head but not its payload."""
    revisit = refers_to is not None
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    url = " ".join((url or "").split())
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{url}')}>"),
              ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("Refers-To-Page-ID", str(refers_to))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to of each page.

    Payloads are grouped by digest and length in a narrow table with a map-side step; a hot
    group only meets in a join whose other side has one row for it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    firsts = (rows.where(F.col("n") >= least).groupBy("digest", "n")
              .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("rows"))
              .where("rows > 1").select(F.col("digest").alias("_digest"), F.col("n").alias("_n"), "largest"))
    firsts = materialize(firsts, "warc-firsts")
    joined = rows.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("n") == F.col("_n")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _write(folder: str):
    def write(batches):
        files, parent = _file_system(folder)
        # a name for this attempt: of a task that runs twice only one reaches the manifest
        name = f"{uuid.uuid4().hex}.warc.gz"
        size, out = 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]):
                out = out or files.open_output_stream(f"{parent}/{name}", compression=None)
                size += out.write(_member(_record(*row)))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], ["path", "size"])
    return write


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write the archives under ``folder`` and return their manifest: path, size."""
    spark = pages.sparkSession
    ship_package(spark)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm_path)
    return materialize(with_revisits(pages, least).mapInArrow(_write(folder), "path string, size long"),
                       "warc-manifest")


def splits(manifest: DataFrame, split_bytes: int) -> DataFrame:
    """Byte ranges of the archives: path, size, first, last (exclusive)."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)),
                                  F.lit(split_bytes).cast("long"))).alias("first")
    return manifest.where("size > 0").select("path", "size", starts).withColumn(
        "last", F.least(F.col("first") + split_bytes, F.col("size")))


class _Window:
    """Bytes of a file from a moving offset on, read in blocks as they are needed."""

    def __init__(self, file, size: int, block: int = 1 << 20):
        self.file, self.size, self.block = file, size, block
        self.at, self.data = 0, b""

    def get(self, offset: int, n: int) -> bytes:
        """Up to n bytes at an offset; fewer only at the end of the file."""
        if offset < self.at or offset + n > self.at + len(self.data):
            self.file.seek(offset)
            self.at, self.data = offset, self.file.read(min(max(n, self.block), max(self.size - offset, 0)))
        return self.data[offset - self.at:offset - self.at + n]


def _begins_as_record(window: _Window, offset: int) -> bool:
    """Does what can be inflated from an offset begin like a WARC record? (In small steps: an error loses a step.)"""
    inflate, out = zlib.decompressobj(31), b""
    try:
        for at in range(offset, offset + (1 << 14), 16):
            out += inflate.decompress(window.get(at, 16))
            if len(out) >= 5:
                break
    except zlib.error:
        pass
    return out.startswith(b"WARC/")


def _inflate(window: _Window, offset: int):
    """The member that begins at an offset, the offset after it and None; None if there is none; and no member,
    but the reason, if it begins as a record does and cannot be inflated to its end."""
    inflate, parts, at = zlib.decompressobj(31), [], offset
    checked = False
    try:
        while not inflate.eof:
            raw = window.get(at, 1 << 14)
            if not raw:
                return (None, at, "ends before its member does") if checked else None
            parts.append(inflate.decompress(raw))
            at += len(raw)
            if not checked and sum(map(len, parts[:2])) >= 5:
                if not b"".join(parts[:2]).startswith(b"WARC/"):
                    return None
                checked = True
    except zlib.error as e:
        return (None, at, str(e)) if checked or _begins_as_record(window, offset) else None
    data = b"".join(parts)
    return (data, at - len(inflate.unused_data), None) if data.startswith(b"WARC/") else None


def _parse(data: bytes):
    """The READ row of a record; None for a record of another type."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    kind = fields.get("WARC-Type")
    if kind not in ("response", "revisit"):
        return None
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(fields[k]) if k in fields else None
    if kind == "response":
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:  # the payload is elsewhere: its length and digest are those that the record states
        stated = dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])
        n, digest, payload = int(stated["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
    return number("Page-ID"), fields.get("WARC-Target-URI"), kind, n, digest, number("Refers-To-Page-ID"), payload


def _records(path: str, size: int, first: int, last: int):
    """The records that begin in a byte range."""
    return (row for row, _ in _scan(path, size, first, last) if row)


def _scan(path: str, size: int, first: int, last: int):
    """The records that begin in a byte range, as (row, None), and its damage, as (None, (path, offset, reason))."""
    files, inner = _file_system(path)
    with files.open_input_file(inner) as file:
        window, at = _Window(file, size), first
        follows = 0 if first == 0 else None  # where the next member begins, if that is known
        while at < last:
            chunk = window.get(at, min(1 << 16, last - at) + len(MAGIC) - 1)
            found = chunk.find(MAGIC)
            if found < 0:
                at += max(len(chunk) - len(MAGIC) + 1, 1)
                continue
            at += found
            member = _inflate(window, at) if at < last else None
            if member is None or member[2] is None and b"\r\nWARC-Type:" not in member[0].partition(b"\r\n\r\n")[0]:
                at = at + 1 if member is None else member[1]  # no record, perhaps inside one
                continue
            if follows is not None and follows < at:
                yield None, (path, follows, "bytes that belong to no record")
            if member[2] is not None:
                yield None, (path, at, member[2])
                at, follows = at + 1, None
                continue
            row = _parse(member[0])
            if row is not None:
                yield row, None
            at = follows = member[1]
        # the range of a record also looks at what follows it in a later range
        if follows is not None and (follows < last or follows < size and window.get(follows, len(MAGIC)) != MAGIC):
            yield None, (path, follows, "bytes that belong to no record")


def _read(with_payload: bool, strict: bool, rows: int = 256):
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    def read(batches):
        found = []
        for part in batches:
            for split in zip(*[part.column(c).to_pylist() for c in ("path", "size", "first", "last")]):
                for row, damage in _scan(*split):
                    if damage and strict:
                        raise ValueError("damaged archive {0} at byte {1}: {2}".format(*damage))
                    if row:
                        found.append(row if with_payload else (*row[:-1], None))
                    if len(found) == rows:
                        yield batch(found)
                        found = []
        if found:
            yield batch(found)
    return read


def _damage(batches):
    for part in batches:
        for split in zip(*[part.column(c).to_pylist() for c in ("path", "size", "first", "last")]):
            found = [d for _, d in _scan(*split) if d]
            if found:
                path, offset, reason = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(offset, pa.int64()), pa.array(reason)],
                                                 ["path", "offset", "reason"])


def _ranges(manifest: DataFrame, split_bytes: int) -> DataFrame:
    spark = manifest.sparkSession
    ship_package(spark)
    total = manifest.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, total // (4 * split_bytes) + 1)
    return splits(manifest, split_bytes).repartition(int(tasks))


def damaged(manifest: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """The damage of archives: path, offset, reason."""
    return _ranges(manifest, split_bytes).mapInArrow(_damage, "path string, offset long, reason string")


def read_archives(manifest: DataFrame, split_bytes: int = 4 << 20, with_payload: bool = True,
                  strict: bool = True) -> DataFrame:
    """The response and revisit records of the archives of a manifest (READ), by byte ranges. Damage is an error,
    unless ``strict`` is false: then the other records are read."""
    return _ranges(manifest, split_bytes).mapInArrow(_read(with_payload, strict), READ)


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write archives in the shared folder and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    folder = fresh_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, least)
    return read_archives(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def open_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest that ``write_archives`` or another writer left as a Parquet table."""
    return spark.read.schema("path string, size long").parquet(path)
