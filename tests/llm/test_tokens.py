import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigclass.llm import packing as P
from sigclass.llm import token_orc as O
from sigclass.llm.tokens import Encoder, default_vocabulary
from sigclass.session import fresh_path


@pytest.fixture(scope="module")
def enc():
    return Encoder()


def test_encoder_equals_the_library_on_whole_texts(enc):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", " \n ", "\t", "\r\n", "\xa0", "　", "é", "漢", "😀", "don't", "'s", "12", "3.4", "--",
             "<|endoftext|>", "\x1c", "\x0b", " ", " Word", "ﬁ", "ǅ"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert enc.ids(t) == enc.whole(t), repr(t)


def test_batches_of_texts_have_the_ids_of_single_texts(enc, plain):
    rng = random.Random(5)
    parts = ["a", " ", " word", "\n", "\n\n", "\n\n\n", " \n", "\t", "é", " 漢字", "don't", ".\nNext", "12", "$$$", "\x1f", "\xa0",
             "<|endoftext|>", "'"]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for size in (1, 7, 4002):
        for at in range(0, 300 if size == 1 else len(texts), size):
            some = texts[at:at + size]
            ids, ends = enc.batch(pa.array([None if t is None else t.encode() for t in some], pa.binary()))
            before = 0
            for t, upto in zip(some, ends.tolist()):
                assert ids[before:upto].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)
                before = upto
            assert before == len(ids)
    ids, ends = enc.batch(pa.array([], pa.binary()))
    assert len(ids) == 0 and len(ends) == 0


def test_a_doc_id_of_very_many_rows_is_spread_over_files(spark, docs_of):
    rows = [(None if i % 3 else i, f"text {i // 2} of many words", "a") for i in range(600)]
    path = fresh_path(spark, "hot-doc-id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        O.write_ids(docs_of(rows), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.orc(path).where("doc_id is null").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 400 and len(files) > 1 and max(r["count"] for r in files) < 300
    stored = spark.read.orc(path).orderBy("place").collect()
    assert [r.doc_id for r in stored] == [None] * 400 + sorted(i for i in range(600) if i % 3 == 0)
    at, starts = 0, []
    for r in stored:
        starts.append((r.doc_id, at, len(r.ids)))
        at += len(r.ids)
    got = O.digests(spark, path).collect()
    assert sorted(starts, key=lambda x: x[1]) == sorted(((r.doc_id, r.start, r.n_tokens) for r in got), key=lambda x: x[1])


@pytest.fixture(scope="module")
def plain():
    """The library's own tokenizer, no setting changed."""
    import tokenizers
    return tokenizers.Tokenizer.from_file(default_vocabulary())


ADDED = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b", "x  <|endoftext|>\n<|endoftext|> y", "<|endoftext|",
         "<|endoftext|><|endoftext|> ", "<|end oftext|>", "\xa0<|endoftext|>"]


def test_ids_are_those_of_an_untouched_tokenizer(enc, plain):
    assert np.frombuffer(enc.ids(ADDED[0]), "<u4").tolist() == [505, 220, 50256, 734]
    rng = random.Random(8)
    parts = ["a", " ", "  ", "\n", "\t ", "\xa0", "é", "don't", "12", "<|", "|>", "endoftext", "<|endoftext|>", ".", " Word"]
    for t in ADDED + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_rows_of_texts_with_an_added_token(docs_of, plain):
    ids = [plain.encode(t, add_special_tokens=False).ids for t in ADDED]
    d = docs_of(list(enumerate(ADDED)))
    at = 0
    for r in sorted(O.round_trip(d).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]) + 1, crc(ids[r.doc_id] + [2]))
        at += r.n_tokens
    pieces = P.pack_along_curve(d).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == [(i, len(x) + 1) for i, x in enumerate(ids)]
    assert all(r.ids_crc32 == crc((ids[r.doc_id] + [0])[r.start:r.start + r.length]) for r in pieces)


def test_memo_is_bounded(enc):
    small = Encoder(max_pieces=5)
    t = " ".join(f"w{i}" for i in range(50))
    assert small.ids(t) == enc.ids(t) and len(small) <= 5


def ids_of(enc, t, end):
    return np.append(np.frombuffer(enc.ids(t or ""), "<u4"), np.uint32(end))


def crc(a):
    return zlib.crc32(np.asarray(a, "<u4").tobytes())


def check_pieces(enc, rows, got, length=1024):
    want = defaultdict(int)
    for i, t, *_ in rows:
        want[i, crc(ids_of(enc, t, 0))] += 1
    total = sum(len(ids_of(enc, t, 0)) for _, t, *_ in rows)
    assert sum(r.length for r in got) == total
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, t, *_ in rows:
        if sum(x[0] == i for x in rows) == 1:
            ids, at = ids_of(enc, t, 0), 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at:at + r.length])
                at += r.length
            assert at == len(ids)
    return sequences


def test_pieces_cover_every_document(docs_of, odd_rows, enc):
    d = docs_of(odd_rows).withColumns({"curve": F.lit("x"), "start": F.lit(1), "length": F.lit(None).cast("int")})
    check_pieces(enc, odd_rows, P.pack_along_curve(d).collect())


def test_padding_is_little_and_copies_lie_together(docs_of, enc):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(5, 400)))) for i in range(300)]
    rows += [(1000 + i, "copy " * 100) for i in range(40)]
    sequences = check_pieces(enc, rows, P.pack_along_curve(docs_of(rows)).collect())
    full = [sum(r.length for r in s) == 1024 for s in sequences.values()]
    assert full.count(False) <= 8  # the last one of each range
    copies = {k for k, s in sequences.items() if any(r.doc_id >= 1000 for r in s)}
    assert len(copies) <= 40 * 201 // 1024 + 10


def test_empty_table(docs_of):
    assert P.pack_along_curve(docs_of([])).collect() == []
    assert O.round_trip(docs_of([])).collect() == []


def test_hilbert_index_is_a_curve():
    bits, n = 3, 2
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    keys = P.hilbert_index(cells, bits)
    assert sorted(keys) == list(range(1 << bits * n))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    cells = np.stack(np.meshgrid(*[range(4)] * 4), -1).reshape(-1, 4)
    path = cells[np.argsort(P.hilbert_index(cells, 2))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_orc_round_trip(docs_of, odd_rows, enc):
    d = docs_of(odd_rows).withColumns({"ids": F.lit("x"), "n_tokens": F.lit(1)})
    got = sorted(O.round_trip(d).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in got] == sorted((r.doc_id is None for r in got), reverse=True)
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted(((i, len(x), crc(x)) for i, x in ((i, ids_of(enc, t, 2)) for i, t, *_ in odd_rows)), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == want


def test_orc_files_hold_the_ids_in_order_with_their_indexes(spark, docs_of, enc):
    from pyarrow import orc
    rows = [(i, f"text number {i} " * (i % 7 + 1)) for i in range(3000)]
    path = fresh_path(spark, "orc-test")
    O.write_ids(docs_of(rows), path)
    found = {r.doc_id: list(r.ids) for r in O.read_ids(spark, path).collect()}
    assert all(found[i] == ids_of(enc, t, 2).tolist() for i, t in rows[::97])
    files = sorted(f for f in spark.read.format("binaryFile").load(path).select("path").toPandas()["path"])
    ranges = []
    for f in files:
        t = orc.ORCFile(f.removeprefix("file:")).read(columns=["doc_id"])["doc_id"].to_pylist()
        assert t == sorted(t)
        ranges.append((t[0], t[-1]))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    plan = O.read_ids(spark, path).where("doc_id = 17")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in plan._jdf.queryExecution().toString()
    assert plan.count() == 1


def test_words_of_earlier_slices_are_not_encoded_again(monkeypatch):
    """Slices of many different words: each word is encoded once, though few entries of single words may be held."""
    enc = Encoder(max_pieces=10)
    made = []
    make = enc.known.make
    enc.known.make = lambda word: made.append(word) or make(word)
    texts = [" ".join(f"w{i}x{j}" for i in range(50)) for j in range(4)]
    for _ in range(3):
        for t in texts:
            ids, ends = enc.batch(pa.array([t, t]))
            assert ids.tobytes() == enc.whole(t) * 2 and ends.tolist() == [len(ids) // 2, len(ids)]
    assert len(made) == len(set(made)) == 4 * 50
    enc.known.max_bytes = 0  # forgets before every batch: the same ids, and no more than a batch's words are held
    for t in texts:
        assert enc.batch(pa.array([t]))[0].tobytes() == enc.whole(t) and len(enc.known.words) == 50
