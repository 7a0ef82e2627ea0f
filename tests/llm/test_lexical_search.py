import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from sigclass.llm import lexical_search as L

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    """Every document scored for every item."""
    held = [(r[0], Counter(terms(r[1]))) for r in docs]
    n_docs, words = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, c in held:
            score = 0
            for t in terms(text):
                if t in c:
                    m = 100 - 25 + 25 * sum(c.values()) * n_docs // words
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs_of, docs, items, **options):
    got = L.search(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], key=str)


def collection(seed, n):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)] + ["été", "漢字", "x1", "A"]
    pick = lambda: words[min(int(rng.expovariate(0.08)), len(words) - 1)]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(pick() for _ in range(rng.randint(0, 30)))) for i in range(n)]
    return docs + docs[: n // 3], [(j, " ".join(pick() for _ in range(rng.randint(0, 25)))) for j in range(25)]


def test_equals_scoring_every_document(spark, docs_of):
    docs, items = collection(1, 400)
    want = plain(docs, items)
    assert found(spark, docs_of, docs, items) == want
    # several shards in a task, and several blocks of queries
    assert found(spark, docs_of, docs, items, shard_docs=37, max_terms=40) == want
    assert found(spark, docs_of, docs, items, k=3, shard_docs=64) == plain(docs, items, 3)


def test_odd_rows(spark, docs_of, odd_rows):
    items = [(1, "one two three w5x5"), (2, None), (3, ""), (4, "same same words aaaaaaaa été"), (5, "repeated ROW " * 300),
             (6, "nowhere"), (None, "in this text")]
    got = found(spark, docs_of, odd_rows, [i for i in items if i[0] is not None])
    assert got == plain(odd_rows, [i for i in items if i[0] is not None])
    assert {r.item_id for r in L.search(docs_of(odd_rows), spark.createDataFrame(items, "item_id long, text string")).collect()} \
        == {1, 4, 5, None}
    assert found(spark, docs_of, [], items[:2]) == [] and found(spark, docs_of, odd_rows, []) == []


def test_most_documents_are_never_scored():
    rng = np.random.RandomState(2)
    n, n_terms = 4096, 30
    doc = np.concatenate([np.sort(rng.choice(n, 800, replace=False)) for _ in range(n_terms)])
    term = np.repeat(np.arange(n_terms), 800)
    impact = (rng.pareto(2.0, len(doc)) * 1000).astype(np.int64) + 1
    shard, scored = L.Shard(doc, term, impact, n), []
    exact = shard.scores

    def counted(terms, repeats, docs):
        scored.extend(docs.tolist())
        return exact(terms, repeats, docs)
    shard.scores = counted
    dense = np.zeros(n, np.int64)
    for t in range(4):
        np.add.at(dense, doc[term == t], impact[term == t])
    docs, scores = shard.search(np.arange(4), np.ones(4, np.int64), 1, 20)
    least = np.sort(dense)[-20]
    assert sorted(zip(docs.tolist(), scores.tolist())) == [(d, s) for d, s in enumerate(dense.tolist()) if s >= least]
    assert len(scored) == len(set(scored)) < n // 2


def test_terms_of_sliced_batches():
    texts = ["Ab c", None, "", "x--Y\x00z é1"]
    flat, n = L.terms_of(pa.array([None if t is None else t.encode() for t in texts], pa.binary()).slice(1))
    assert [t.decode() for t in flat.to_pylist()] == ["x", "y", "z", "é1"] and n.tolist() == [0, 0, 4]
