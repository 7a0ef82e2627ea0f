import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sigclass.llm import suffix_dedup as S


def plain(docs, length):
    """Every window of every text, counted."""
    texts = [(i, (t or "").encode()) for i, t, *_ in docs]
    windows = Counter(t[a:a + length] for _, t in texts for a in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - length + 1):
            if windows[t[a:a + length]] > 1:
                gone[a:a + length] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs_of, docs, length, **options):
    got = S.without_repeats(docs_of(docs), length, **options).collect()
    want = plain(docs, length)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == want
    return want


def texts(seed, n, length, alphabet="abcd "):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.randint(length - 3, 3 * length)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice([word(rng.randint(0, 2 * length)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 9):]])
                 for _ in range(rng.randint(0, 4))]
        docs.append((i, "".join(parts)))
    near = []
    for i, t in docs[: n // 3]:
        near.append((n + i, t))
        if len(t) > 3:
            at = rng.randrange(len(t))
            near.append((2 * n + i, t[:at] + "#" + t[at + 1:]))
    return docs + near


@pytest.mark.parametrize("length, gram", [(40, 10), (40, 16), (33, 32)])
def test_equals_counting_all_windows(docs_of, length, gram):
    docs = texts(length + gram, 60, length)
    want = check(docs_of, docs, length, gram=gram)
    assert sum(r[2] > 0 for r in want) > 30 and sum(0 < r[2] < r[1] for r in want) > 15
    # small buckets, so that grams and windows lie across boundaries, and texts cut into pieces
    assert check(docs_of, docs, length, gram=gram, bucket=25, piece=3 * length) == want


def test_the_given_length(docs_of):
    docs = texts(9, 40, 200, "abcdefghij \n")
    docs += [(900, "x" * 1000), (901, "ab" * 150), (902, "é" * 100), (903, "é" * 101), (904, "y" * 199), (905, "y" * 199)]
    docs += [(910 + i, "Terms of use: " + "nothing is promised here. " * 9 + f"number {i}" * (i % 7)) for i in range(60)]
    check(docs_of, docs, 200)
    check(docs_of, docs, 200, bucket=10)


def test_odd_rows(docs_of, odd_rows):
    assert {r[0]: r[2] for r in check(docs_of, [r for r in odd_rows if len(r[1] or "") < 60_000], 200)}[11] == 50_000
    assert S.without_repeats(docs_of([])).count() == 0
    long_text = odd_rows[9][1]
    got = {r.doc_id: r for r in S.without_repeats(docs_of([(1, long_text), (2, long_text + " more")])).collect()}
    assert got[1].n_removed == len(long_text) and got[1].kept_sha256 == hashlib.sha256().hexdigest()
    # the text repeats itself, and with it the space after its last word
    assert got[2].kept_sha256 == hashlib.sha256(b"more").hexdigest() and got[2].n_spans == 1


def test_other_columns(spark):
    docs = spark.createDataFrame([(i, "z" * (150 + 60 * i), b"x", i, i) for i in range(3)],
                                 "doc_id int, text string, digest binary, place long, spans int")
    assert {r.doc_id: r.n_removed for r in S.without_repeats(docs).collect()} == {0: 0, 1: 210, 2: 270}


def test_multikey_quicksort():
    rng = np.random.RandomState(1)
    for n in (0, 1, 2, 50, 3000):
        words = rng.randint(0, 3, (n, 6)).astype(np.uint64)
        order = S.multikey_order(words)
        assert [tuple(words[i]) for i in order] == sorted(map(tuple, words)) and sorted(order) == list(range(n))
