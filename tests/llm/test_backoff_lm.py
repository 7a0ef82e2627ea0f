import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigclass.llm import backoff_lm as B

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, order=2, backoff=0.4):
    texts = [WORDS.findall((r[1] or "").translate(LOWER)) for r in rows]
    grams = lambda x, n: [tuple(x[i - n + 1:i + 1]) for i in range(n - 1, len(x))]
    total = {n: Counter(g for x in texts for g in grams(x, n)) for n in range(1, order + 1)}
    words = sum(total[1].values())
    out = []
    for r, x in zip(rows, texts):
        own = {n: Counter(grams(x, n)) for n in total}
        left = lambda g: total[len(g)][g] - own[len(g)][g]
        score = back = unseen = 0
        for i in range(len(x)):
            paid = 0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(x[i - n + 1:i + 1])
                if n == 1:
                    s = math.log(max(left(g), 1) / max(words - len(x), 1))
                elif left(g) > 0:
                    s = math.log(left(g) / max(left(g[:-1]), 1))
                else:
                    paid += 1
                    continue
                break
            score += s + paid * math.log(backoff)
            back += paid > 0
            unseen += left((x[i],)) == 0
        out.append((r[0], len(x), score, back, unseen))
    return out


def check(rows, got):
    key = lambda r: (str(r[0]), r[1], round(r[2], 4))
    a = sorted(brute(rows), key=key)
    b = sorted(((r.doc_id, r.n_words, r.log_score, r.n_backed_off, r.n_unseen) for r in got), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[0] == y[0] and x[1] == y[1] and x[3:] == y[3:] and x[2] == pytest.approx(y[2], abs=1e-6)


def rows_of(n):
    rng = random.Random(5)
    return [(i, " ".join(rng.choice("the The of a b c d e".split() + [f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 60))))
            for i in range(n)]


def test_against_brute_force_with_many_chunks_and_parts(docs_of):
    rows = rows_of(120)
    check(rows, B.score(docs_of(rows), chunk_bytes=500, part_grams=200).collect())


def test_third_order(docs_of):
    rows = rows_of(60)
    got = {r.doc_id: r for r in B.score(docs_of(rows), order=3, chunk_bytes=2000).collect()}
    for i, n, s, back, unseen in brute(rows, order=3):
        assert (got[i].n_words, got[i].n_backed_off, got[i].n_unseen) == (n, back, unseen)
        assert got[i].log_score == pytest.approx(s, abs=1e-6)


def test_registered_query_is_of_third_order(spark, docs_of, tmp_path):
    from sigclass.llm.queries import QUERIES
    rows = rows_of(80)
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op7_backoff_lm"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, n, s, back, unseen in brute(rows, order=3):
        assert (got[i].n_words, got[i].n_backed_off, got[i].n_unseen) == (n, back, unseen)
        assert got[i].log_score == pytest.approx(s, abs=1e-6)


def test_repeated_rows_enter_a_chunk_once(docs_of, monkeypatch):
    rows = rows_of(30) + [(None, "the of the w1"), (5, None)] * 3 + [(7, "a hot row of the table")] * 400
    monkeypatch.setattr(B, "COPIES", 7)
    got = B.score(docs_of(rows), chunk_bytes=500, part_grams=200)
    check(rows, got.collect())
    dealt, repeats = B._counted(docs_of(rows).select("doc_id", F.col("text").cast("binary").alias("text")))
    dealt = dealt.collect()
    assert repeats and len(dealt) == len({(r.doc_id, r.text) for r in dealt}) == len(set(rows))
    assert sum(r.copies for r in dealt) == len(rows) and max(r.copies for r in dealt) == 400


def test_parts_are_ranges_and_blocks_round_trip():
    import numpy as np
    v = np.unique(np.random.RandomState(1).randint(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    v = np.concatenate([v, np.array([2**64 - 1], np.uint64)])
    for parts in (1, 2, 3, 64, 1000, 70_000):
        part, within = B._dealt(v, parts)
        assert (np.diff(part) >= 0).all() and part.max() < parts and int(within.max()) < 2**48
        assert len(set(zip(part.tolist(), within.tolist()))) == len(v)
        assert (np.diff(within.astype(np.int64))[np.diff(part) == 0] > 0).all()
    assert B._unpacked(B._packed(v.tobytes(), 8), 8) == v.tobytes()


def test_odd_rows_and_clashing_columns(docs_of, odd_rows):
    d = docs_of(odd_rows).withColumns({"chunk": F.lit("x"), "part": F.lit(1)})
    got = B.score(d).collect()
    check(odd_rows, got)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_empty_table(docs_of):
    assert B.score(docs_of([])).collect() == []


def test_six_byte_blocks():
    import numpy as np
    v = np.array([0, 1, 2**48 - 1, 123456789012], np.uint64)
    assert (B._from_six(B._six(v)) == v).all()
