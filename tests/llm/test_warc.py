import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sigclass.llm import warc
from sigclass.session import fresh_path

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        keep = max((x for x in groups[h or ""] if x is not None), default=None) if len(data) >= 1000 else None
        revisit = keep is not None and i != keep
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def pages():
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 400)) for i in range(300)]
    rows += [(1000 + i, "u", "same " * 300) for i in range(50)] + [(2000 + i, "u", "small") for i in range(5)]
    rows += [(3000, None, None), (3001, "", ""), (None, "u", "x" * 2000), (None, "v", "same " * 300), (3002, "a\r\nWARC-Type: x", "é" * 600),
             (3003, "u", "rep " * 400), (3003, "u", "rep " * 400), (3004, "u", "WARC/1.1\r\n\r\n" * 9000),
             (3005, "u", "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(200_000)))]
    return rows


def test_round_trip_against_brute_force(spark):
    rows = pages()
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit(1), "payload": F.lit("x"), "n": F.lit(None).cast("int")})
    assert sorted(map(tuple, warc.round_trip(d).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("split", [501, 4096, 1 << 22])
def test_every_split_size_reads_each_record_once(spark, split):
    rows = pages()[:320]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), fresh_path(spark, "warc-test"))
    got = warc.read_archives(manifest, split_bytes=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_magic_numbers_inside_members_are_not_records(tmp_path):
    record = warc._record(1, "u", b"first", hashlib.sha1(b"first").hexdigest(), None)
    inner = warc._member(b"WARC/1.1\r\nnot at a member's begin") * 3 + warc.MAGIC * 50 + gzip.compress(b"other data")
    stored = warc._record(2, "u", inner, hashlib.sha1(inner).hexdigest(), None)
    import zlib
    c = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: the payload's bytes are in the file as they are
    data = warc._member(record) + c.compress(stored) + c.flush() + warc._member(record)
    f = tmp_path / "a.warc.gz"
    f.write_bytes(data)
    for step in (64, 1000, len(data)):
        got = [r for a in range(0, len(data), step) for r in warc._records(str(f), len(data), a, min(a + step, len(data)))]
        whole = [r for r in got if r[0] == 1]
        assert len(whole) == 2 and sum(r[0] == 2 for r in got) == 1


def test_damage_is_never_silent(spark, tmp_path):
    import zlib
    payloads = [(b"%d " % i) * 2000 + bytes(range(256)) * 40 for i in range(3)]
    members = [warc._member(warc._record(i, "u", p, hashlib.sha1(p).hexdigest(), None)) for i, p in enumerate(payloads)]
    whole = b"".join(members)
    begins = [0, len(members[0]), len(members[0]) + len(members[1])]
    flipped = bytearray(whole)
    flipped[begins[1] + len(members[1]) // 2] ^= 0xFF
    headless = bytearray(whole)
    headless[begins[1]] ^= 0xFF
    cases = {"whole": (whole, [0, 1, 2], []), "cut": (whole[:-20], [0, 1], [begins[2]]), "flipped": (bytes(flipped), [0, 2], [begins[1]]),
             "headless": (bytes(headless), [0, 2], [begins[1]]), "tail": (whole + b"\0" * 30, [0, 1, 2], [len(whole)])}
    for name, (data, records, damage) in cases.items():
        (tmp_path / name).write_bytes(data)
        manifest = spark.createDataFrame([(str(tmp_path / name), len(data))], "path string, size long")
        for split in (97, 1 << 20):
            got = warc.read_archives(manifest, split, strict=False).collect()
            assert sorted(r.page_id for r in got) == records, (name, split)
            found = warc.damaged(manifest, split).collect()
            assert all(r.path == str(tmp_path / name) and r.reason for r in found)
            if split > 97:
                assert [r.offset for r in found] == damage, name
            assert bool(found) == bool(damage), (name, split)
        if damage:
            with pytest.raises(Exception, match="damaged archive"):
                warc.read_archives(manifest).collect()


def test_schemes_of_spark_are_known():
    assert warc._arrow_uri("s3a://b/k") == "s3://b/k" and warc._arrow_uri("hdfs://n:1/p") == "hdfs://n:1/p"
    assert warc._arrow_uri("wasbs://c@a.blob.core.windows.net/p") == "abfss://c@a.dfs.core.windows.net/p"
    assert warc._arrow_uri("file:///a/b") == "/a/b" == warc._arrow_uri("/a/b") and warc._arrow_uri("gs://b/k") == "gs://b/k"


def test_archives_are_standard_gzip_members(spark):
    rows = pages()[:40]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), fresh_path(spark, "warc-std"))
    text = b"".join(gzip.open(r.path.removeprefix("file:")).read() for r in manifest.collect())
    assert text.count(b"WARC/1.1\r\n") == len(rows)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
