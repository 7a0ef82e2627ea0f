import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sigclass.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def counts(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in s.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(t):
    found = [(m.start(), n, m.end(), k) for n, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], t or "") if counts(k, m[0])]
    return sorted(found)


def joined(found):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)


def check(rows, got):
    want = sorted(((i, *[sum(x[3] == k for x in base(t)) for k in PLAIN], hashlib.sha256(joined(base(t)).encode()).hexdigest())
                   for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=str) == want


def test_base_spans_against_plain_patterns(docs_of):
    rng = random.Random(11)
    parts = ["a@b.c", "x.y@", "@z.com", "_d@e-f.org", ".", "-", " ", "+", "%", "1", "22", "256", "0255", ".1.2.3", "10.0.0.1",
             "4111 1111 1111 1111", "4111-1111", "+1 (799) 555-3729", "+49", "(", ")", "é", "😀", "\n", "00000000", "abc", "@", "5500000000000004"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    rows += [(9001, "a@b.c_d@e.f"), (9002, "1.2.3.4.5.6.7.8"), (9003, "+1+2 345 678 90+"), (9004, "a@b.c.d@e.f"), (9005, "+1 ( ")]
    check(rows, pii.find(docs_of(rows)).collect())


def test_odd_rows_and_clashing_columns(docs_of, odd_rows):
    rows = odd_rows + [(20, "a" * 30_000 + "@b.de"), (21, "1 " * 30_000), (22, "+" * 5000 + "1 234 567 89"), (23, "a." * 20_000 + "@ 1.1.1.1")]
    d = docs_of(rows).withColumns({"spans": F.lit(1), "base": F.lit("x"), "start": F.lit(2)})
    got = pii.find(d).collect()
    check(rows, got)


def test_empty_table(docs_of):
    assert pii.find(docs_of([])).collect() == []


def test_looser_spans_are_added_where_the_votes_agree(docs_of):
    rows = [(i, f"call +1 (799) 555-{1000 + i} or mail ann.{i}@mail.example.com from 10.1.2.{i % 200} now") for i in range(200)]
    rows += [(500, "write to bob (at) example (dot) com today"), (501, "no data here, only 1234 words and 99.5 percent")]
    got = {r.doc_id: r for r in pii.find(docs_of(rows)).collect()}
    for i, t in rows:
        spans = set(filter(None, got[i].spans.split(",")))
        assert set(filter(None, joined(base(t)).split(","))) <= spans
    assert got[500].n_email == 0 and got[500].spans == "email:9:35"
    assert got[501].spans == ""


def test_reliabilities_favour_the_labelers_that_agree():
    shape = {"length_class": 1, "many_signs": False}
    p = [{"kind": "card", "base": True, "v_form": 1, "v_check": 1, "v_list": 1, "v_context": 0, "v_edges": 1, "n": 100, **shape},
         {"kind": "card", "base": False, "v_form": 1, "v_check": -1, "v_list": -1, "v_context": 0, "v_edges": 1, "n": 900, **shape}]
    posterior, reliability = pii.estimate(p)
    assert posterior[0] > 0.95 and posterior[1] < 0.05
    ratio = {v: reliability[v][1][1] / reliability[v][0][1] for v in ("v_check", "v_form")}
    assert ratio["v_check"] > 10 > ratio["v_form"]
    weights = pii.train(p, posterior)
    score = [sum(a * b for a, b in zip(weights, pii._features(x))) for x in p]
    assert score[0] > 0 > score[1]


def test_no_python_in_the_plan(docs_of):
    d = pii.find(docs_of([(1, "a@b.cd")]))
    assert not re.search("Python|Pandas|Arrow", d._jdf.queryExecution().executedPlan().toString())
    with pytest.raises(Exception):
        pii.find(d.select("spans"))  # needs doc_id and text
