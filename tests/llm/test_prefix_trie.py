import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sigclass.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Every prefix of every rebuilt conversation, by dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            text = text or ""
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(r, t) for *_, r, _, t in sorted(x, key=lambda y: y[:4])] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(first, [])[:h] + turns[h:]
    members, ends, children = defaultdict(set), defaultdict(set), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].add(c)

    def value(n):
        return (len(members[n]) - 1) * (len(re.findall("[^\x20\x09-\x0D]+", n[-1][1])) if n else 0)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += value(n)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def check(spark, rows, width=T.WIDTH):
    clashing = {n: F.lit(n) for n in ("depth", "block", "k", "pos", "place", "words", "t1", "one")}
    got = T.prefix_trie(spark.createDataFrame(rows, SCHEMA).withColumns(clashing), width).collect()
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got) == plain(rows)


ODD = [(1001, None, None, None), (1001, None, "user", ""), (1001, 0, "user", "x"), (1001, 0, "user", "x"), (1002, 5, None, "x y"),
       (None, 1, "user", "left out"), (1021, 1, "user", "only"), (1041, 0, "user", "short"), (1003, 1, "user", "b"),
       (1003, 1, "user", "a"), (1003, 1, "assistant", "a"), (-7, 1, "user", "x"), (1000, 0, "user", "word " * 50_000),
       (1000, 0, "user", "\u3000 \x1c"), (1020, 1, "user", "word " * 50_000)]


@pytest.mark.parametrize("width", [2, 6])
def test_trie_equals_all_prefixes(spark, width):
    rng = random.Random(width)
    rows = list(ODD)
    for c in range(90):
        start = rng.choice([["sys a", "hi"], ["sys a"], [], ["sys b", "hi", "well", "go on", "yes", "no", "so"]])
        texts = start + [rng.choice(["one", "two words", "a b c"]) for _ in range(rng.randint(0, 3 if c % 9 else 17))]
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    check(spark, rows, width)


def test_an_empty_table_has_no_nodes(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_many_equal_conversations_and_a_long_one(spark):
    rows = [(c, 0, "user", "same") for c in range(20, 3000)] + [(7, i, "user", f"turn {i % 5}") for i in range(1200)]
    check(spark, rows)
