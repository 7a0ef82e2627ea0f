import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as C
from sigclass.llm.tokens import Encoder
from tests.llm import test_near_duplicates as near_tests
from tests.llm.test_mixing import brute_targets
from tests.llm.test_quality import brute as counts_of
from tests.llm.test_tokens import check_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture_rows():
    rng = random.Random(6)
    good = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 120))) for _ in range(150)]
    bad = [" ".join(f"#{rng.randint(0, 10**6)}|<$>" for _ in range(rng.randint(60, 120))) for _ in range(150)]
    rows = [(2 * i, t, f"s{i % 4}") for i, t in enumerate(good + bad)]
    labels = [(2 * i, int(i < len(good)), 0) for i in range(len(rows))]
    rows += [(1001 + i, good[i], "copy") for i in range(10)]  # exact copies of other sources
    rows += [(2001 + i, good[20 + i] + " tail", f"s{i % 3}") for i in range(10)]  # near copies
    rows += [(3001, "too short", "s1"), (3002, None, None), (3003, "a b " * 60, "s2"), (3004, "", "s0")]
    rng.shuffle(rows)
    return rows, labels


def plain_quality(rows):
    def keeps(t):
        n, _, symbols, _, repeated = counts_of(t)
        return n >= 50 and 100 * repeated <= 50 * n and not symbols
    return [r for r in rows if keeps(r[1])]


def plain_exact(rows):
    best = {}
    for r in rows:
        best[r[1]] = max(best.get(r[1], r), r)
    return list(best.values())


def plain_near(rows):
    kept = {d for d, _, _, own in near_tests.brute(rows) if own}
    return [r for r in rows if r[0] in kept]


def check_mix(rows, got):
    """Each source: whole epochs, then further documents until its target is reached."""
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    sizes, copies, taken = defaultdict(int), Counter(r.doc_id for r in got), defaultdict(int)
    for r in rows:
        sizes[r[2]] += size[r[0]]
    targets = brute_targets(sizes)
    for i, _, source in rows:
        epochs = int(targets[source] + 1e-9) // sizes[source]
        assert copies[i] in (epochs, epochs + 1)
        taken[source] += copies[i] * size[i]
    for s, n in taken.items():
        assert 0 <= n - int(targets[s] + 1e-9) < max(size[r[0]] for r in rows if r[2] == s)
    text = {r[0]: (r[1], r[2]) for r in rows}
    assert set(copies) <= set(text) and all((r.text, r.source) == text[r.doc_id] for r in got)


def test_run_and_every_stage_against_a_plain_version(spark, docs_of, labels_of, tmp_path, monkeypatch):
    rows, labels = fixture_rows()
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(labels).write.parquet(f"{tmp_path}/labels.parquet")
    written = []

    def recorded(df, name, keep=C.materialize):
        written.append((name, keep(df, name)))
        return written[-1][1]
    monkeypatch.setattr(C, "materialize", recorded)
    last = C.run(spark, str(tmp_path))
    assert [n for n, _ in written] == ["quality-rules", "exact-dedup", "near-dedup", "mixing"]
    for _, df in written:
        assert df.columns == COLUMNS and df.schema["doc_id"].dataType.simpleString() == "bigint"
    collected = [df.collect() for _, df in written]
    plain = rows
    for step, got in zip((plain_quality, plain_exact, plain_near), collected):
        fewer = step(plain)
        assert 0 < len(fewer) < len(plain)
        plain = fewer
        assert sorted((r.doc_id, r.text, r.source) for r in got) == sorted(plain)
        assert all((r.lang, r.n_chars) == ("en", len(r.text)) for r in got)
    check_mix(plain, collected[3])
    assert last.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_pieces(Encoder(), [(r.doc_id, r.text) for r in collected[3]], last.collect())


#: Names that the stages use for columns of their own.
PRIVATE = ["row", "id", "text_hash", "digest", "keep_id", "keep_rows", "group_size", "size", "key", "taken", "epochs", "cut_key", "cut_words",
           "cut_size", "target", "source_size", "comp", "kept", "n_shingles", "component_id", "place", "curve", "_row", "_of", "_doc",
           "_hash", "_text", "_stay", "_key", "_size", "_epoch", "_digest", "_keep_id", "node", "n", "rows"]


def test_stages_keep_columns_that_clash_with_their_own(spark, docs_of, labels_of, tmp_path):
    rows, labels = fixture_rows()
    docs = docs_of(rows).withColumns({n: F.concat(F.lit(n + " of "), F.col("doc_id")) for n in PRIVATE})
    labels_of(labels).write.parquet(f"{tmp_path}/labels.parquet")
    plain = {r.doc_id: r for r in docs.collect()}
    for i, (name, stage) in enumerate(C.STAGES):
        docs = C.materialize(stage(spark, docs, str(tmp_path)), "clash")
        if name != "packing":
            got = docs.collect()
            assert docs.columns == [*COLUMNS, *PRIVATE] and got and all(r == plain[r.doc_id] for r in got), name
    assert docs.columns[0] == "doc_id" and docs.count()


def test_odd_rows_and_an_empty_table_go_through_all_stages(spark, docs_of, labels_of, odd_rows, tmp_path):
    labels_of([(i, i % 2, 0) for i in range(1, 12)]).write.parquet(f"{tmp_path}/labels.parquet")
    for name, rows in (("odd", odd_rows), ("empty", [])):
        docs = docs_of(rows)
        for _, stage in C.STAGES:
            docs = C.materialize(stage(spark, docs, str(tmp_path)), name)
        got = docs.collect()
        assert docs.columns[0] == "doc_id" and (not got) >= (not rows)
        assert {r.doc_id for r in got} <= {r[0] for r in rows}
