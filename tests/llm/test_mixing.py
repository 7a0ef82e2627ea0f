import re
from collections import defaultdict

from pyspark.sql import functions as F

from sigclass.llm import mixing as M

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), total=1.5, most=2):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, rest, out = set(names), total * sum(sizes.values()), {}
    while free:
        all_w = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / all_w > most * sizes[s] + 1e-9]
        if not over:
            out.update({s: rest * w[s] / all_w for s in free})
            break
        for s in over:
            out[s] = most * sizes[s]
            free.remove(s)
        rest -= sum(out[s] for s in over)
    return out


def check(docs, rows, exact=True):
    frame = M.sized(docs)
    got = M.taken_words(frame, M.plan_mix(frame)).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(WORDS.findall(r[1] or ""))
    want = brute_targets(sizes)
    source = {r[0]: r[2] for r in rows}
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.source_size == sizes[source[r.doc_id]]
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - int(want[s] + 1e-9)) <= (0 if exact else 5)
    return got


def test_targets_and_exact_cuts(docs_of):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), f"s{i % 5}" if i % 11 else None) for i in range(300)]
    rows += [(1000 + i, "big " * 50, "hot") for i in range(200)]
    got = check(docs_of(rows), rows)
    again = check(docs_of(rows[::-1]), rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_rows(docs_of):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", None), (4, "x y z", "b"), (5, "long " * 5000, "b"), (6, " \n", "empty")]
    check(docs_of(rows), rows)


def test_repeated_rows_are_cut_alike(docs_of):
    rows = [(7, "one two three four", "a")] * 6 + [(8, "x", "b")] * 3
    d = docs_of(rows)
    frame = M.sized(d)
    got = M.taken_words(frame, M.plan_mix(frame)).where("doc_id = 7").collect()
    assert len(got) == 6 and len({r.taken for r in got}) == 1


def test_null_ids_and_clashing_columns(docs_of, odd_rows):
    d = docs_of(odd_rows).withColumns({"size": F.lit("x"), "key": F.lit("y"), "target": F.lit("z")})
    frame = M.sized(d)
    plan = M.plan_mix(frame)
    assert M.taken_words(frame, plan).count() == len(odd_rows)
    mixed = M.mixed_rows(d, plan)
    assert mixed.columns == d.columns and mixed.count() > 0


def test_empty_table_and_no_words(docs_of):
    frame = M.sized(docs_of([]))
    assert M.taken_words(frame, M.plan_mix(frame)).collect() == []
    frame = M.sized(docs_of([(1, None, "a"), (2, "", "b")]))
    assert [(r.target, r.taken) for r in M.taken_words(frame, M.plan_mix(frame)).collect()] == [(0.0, 0)] * 2


def test_mixed_rows_repeat_epochs(docs_of):
    rows = [(i, "a b c d", f"s{i % 4}") for i in range(200)]
    d = docs_of(rows)
    frame = M.sized(d)
    plan = M.plan_mix(frame)
    words = {r.doc_id: r.taken for r in M.taken_words(frame, plan).collect()}
    copies = {r.doc_id: r["count"] for r in M.mixed_rows(d, plan).groupBy("doc_id").count().collect()}
    for i, t in words.items():
        assert copies.get(i, 0) == -(-t // 4)
