"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from two patterns for each kind: the base pattern and a looser
one. Labelers vote on each candidate (yes, no or abstain): the strict form, a
checksum or range, a gazetteer (domain endings, calling codes, issuer digits), words
before it, and free edges. The corpus is reduced to counts of vote patterns, a
table as small as the number of patterns. Expectation-maximisation on these counts
estimates each labeler's reliability; a logistic span classifier is then trained
on the posteriors with the votes and the span's shape as features. Base spans always
stay; a looser candidate is added where the classifier is confident.

Positions: a text split at a pattern gives the gaps between its matches, so
running sums of gap and match lengths are the matches' places in code points.

Defined results: a null text is empty and has no spans. An added span never
overlaps a base span. Rows are judged one by one, so null or repeated doc_ids and
repeated rows need no rule; an empty table gives no rows. Without any candidate in
the corpus nothing is added. Extra columns are not read. The patterns match what
the plain ones match but never return to what they have read, so long runs of one
character cost linear time and no stack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigclass.session import materialize

#: Kinds in the order of the output (fixed).
KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "A-Za-z0-9._%+-"
#: A match may begin where the last one ended or where no longer match could have begun before.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match (cheap test before the two passes of a pattern).
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]",
         "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[a-z0-9-]{2,63}+){1,8}+",
    "ip": r"(?i)(?<![0-9a-f:])[0-9a-f]{1,4}+(?::[0-9a-f]{1,4}+){7}+(?![0-9a-f:])",
    "card": r"(?<![0-9])[0-9]{4}([ .])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
LOOSE_NEEDS = {"email": r"(?i)[\[(] ?at ?[\])]", "ip": r"(?i)[0-9a-f]:[0-9a-f]", "card": r"[0-9]{4}[ .][0-9]{4}",
               "phone": r"[0-9]{3}[ .-][0-9]{4}"}
#: Gazetteers and context words of the labelers (fixed values).
ENDINGS = "com|org|net|edu|gov|int|info|biz|io|de|fr|es|it|uk|nl|eu|us|ca|ch|at|be|pl|se|br|mx|in|jp|cn|au"
CALLING = "1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6(?:011|4[4-9]|5)"
CONTEXT = {"email": "mail|write to|contact", "ip": "ip|host|server|client|address",
           "card": "card|visa|mastercard|amex|credit|debit", "phone": "tel|phone|call|fax|mobile|cell|ring"}
VOTES = ["v_form", "v_check", "v_list", "v_context", "v_edges"]
#: Probability that the classifier must give a looser candidate.
CONFIDENT = 0.8

_PLACE = "array<struct<start: int, end: int, match: string>>"


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches: start and end in code points, and the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found,
                       lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(
            start.alias("start"), end.alias("end"), x["match"].alias("match"))).alias("found"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACE).alias("found"))
    return F.when(text.rlike(needs), F.aggregate(steps, first, step, lambda acc: acc["found"])).otherwise(
        F.array().cast(_PLACE))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d < 5, d * 2).otherwise(d * 2 - 9)
        return F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _checks(kind: str, match: Column) -> Column:
    """Whether a match of the base pattern counts."""
    digits = _digits(match)
    if kind == "ip":  # no part above 255, however many zeros it begins with
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, F.lit(1))
    return (vote.when(no, F.lit(-1)) if no is not None else vote).otherwise(F.lit(0))


def _candidate(kind: str, text: Column, m: Column, base: bool) -> Column:
    """A candidate with its labelers' votes and shape."""
    match, digits = m["match"], _digits(m["match"])
    ok = _checks(kind, match) if base else F.lit(False)
    if kind == "email":
        check = _vote(match.rlike(r"[A-Za-z0-9]"), ~match.rlike("[A-Za-z]"))
        listed = _vote(match.rlike(rf"(?i)(?:\.|[\])] ?)(?:{ENDINGS})$"))
    elif kind == "ip":
        check = _vote(ok, ~ok if base else None)
        listed = _vote(match.rlike(r"^(?!0|127\.|22[4-9]|2[3-5][0-9])"), match.rlike(r"^(?:0|127\.)"))
    elif kind == "card":
        luhn = F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
        check = _vote(luhn, ~luhn)
        listed = _vote(digits.rlike(rf"^(?:{ISSUERS})"), ~digits.rlike(rf"^(?:{ISSUERS})"))
    else:
        check = _vote(F.length(digits).between(9, 15), ~F.length(digits).between(9, 15))
        listed = _vote(match.rlike(rf"^\+(?:{CALLING})"))
    before = F.substring(text, F.greatest(m["start"] - 29, F.lit(1)), F.least(m["start"], F.lit(30)))
    edge_before = F.substring(text, m["start"], F.when(m["start"] > 0, F.lit(1)).otherwise(F.lit(0)))
    edge_after = F.substring(text, m["end"] + 1, F.lit(1))
    return F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
        (ok if base else F.lit(False)).alias("base"),
        _vote(F.lit(True) if base else F.lit(False)).alias("v_form"), check.alias("v_check"), listed.alias("v_list"),
        _vote(F.lower(before).rlike(rf"\b(?:{CONTEXT[kind]})")).alias("v_context"),
        _vote(edge_before.rlike(r"^[\s(\[<\"':,;]?$") & edge_after.rlike(r"^[\s)\]>\"':,;.!?]?$"),
              edge_before.rlike(r"\w") | edge_after.rlike(r"\w")).alias("v_edges"),
        F.least(F.length(match) / 8, F.lit(3)).cast("int").alias("length_class"),
        (F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")) > 3).alias("many_signs"))


def _judge(kind: str, text: Column, base: bool):
    return lambda m: _candidate(kind, text, m, base)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of each document, written once: the only pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for kind in KINDS:
        for base, pattern, needs in ((True, BASE[kind], NEEDS[kind]), (False, LOOSE[kind], LOOSE_NEEDS[kind])):
            found.append(F.transform(_matches(text, pattern, needs), _judge(kind, text, base)))
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                   F.concat(*found).alias("spans")), "pii-candidates")


def vote_patterns(found: DataFrame) -> list[dict]:
    """How often each combination of kind, votes and shape occurs: at most some thousand rows, as
    every part of it has a few values."""
    keys = ["kind", "base", *VOTES, "length_class", "many_signs"]
    rows = found.select(F.explode("spans").alias("s")).select("s.*").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sorted((r.asDict() for r in rows.toLocalIterator()), key=lambda r: [str(r[k]) for k in keys])


def estimate(patterns: list[dict], rounds: int = 30, prior: float = 5.0):
    """Expectation-maximisation: the probability of each pattern to be personal data, and each
    labeler's reliability P(vote | personal or not). ``prior`` pseudo-votes say that a yes is
    likelier for personal data and a no for others."""
    believed = {1: {1: 0.7, 0: 0.25, -1: 0.05}, 0: {1: 0.1, 0: 0.4, -1: 0.5}}
    reliability = {v: {y: dict(believed[y]) for y in (0, 1)} for v in VOTES}
    share = {k: 0.5 for k in KINDS}
    posterior = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, p in enumerate(patterns):
            odds = math.log(share[p["kind"]] / (1 - share[p["kind"]]))
            for v in VOTES:
                odds += math.log(reliability[v][1][p[v]] / reliability[v][0][p[v]])
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in KINDS:
            own = [(p["n"], q) for p, q in zip(patterns, posterior) if p["kind"] == k]
            share[k] = (sum(n * q for n, q in own) + 1) / (sum(n for n, _ in own) + 2)
        for v in VOTES:
            for y in (0, 1):
                weight = {x: prior * believed[y][x] for x in (1, 0, -1)}
                for p, q in zip(patterns, posterior):
                    weight[p[v]] += p["n"] * (q if y else 1 - q)
                total = sum(weight.values())
                reliability[v][y] = {x: w / total for x, w in weight.items()}
    return posterior, reliability


def _features(p, lit=lambda x: x, flag=lambda x: float(x)) -> list:
    """Features of a candidate; for a dict numbers, for a struct column expressions."""
    return [flag(p["kind"] == k) for k in KINDS] + [lit(p[v]) for v in VOTES] + [
        flag(p["length_class"] >= 2), flag(p["many_signs"])]


def train(patterns: list[dict], posterior: list[float], steps: int = 400, rate: float = 0.5, l2: float = 1e-3) -> list[float]:
    """Weights of the logistic span classifier, fitted to the posteriors of the patterns, each
    weighted by the square root of its count, so that rare forms count as well."""
    rows = [(_features(p), math.sqrt(p["n"]), q) for p, q in zip(patterns, posterior)]
    weights = [0.0] * (len(KINDS) + len(VOTES) + 2)
    total = sum(w for _, w, _ in rows) or 1.0
    for _ in range(steps):
        slope = [l2 * w for w in weights]
        for x, w, q in rows:
            z = sum(a * b for a, b in zip(weights, x))
            error = w * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - q) / total
            for i, a in enumerate(x):
                slope[i] += error * a
        weights = [w - rate * s for w, s in zip(weights, slope)]
    return weights


def spans(found: DataFrame, weights: list[float], confident: float = CONFIDENT) -> DataFrame:
    """doc_id, base (the base spans) and spans (with the added ones), each in order of start and kind."""
    cut = math.log(confident / (1 - confident))

    def score(s):
        terms = _features(s, flag=lambda c: F.when(c, 1.0).otherwise(0.0))
        return sum((F.lit(w) * t for w, t in zip(weights, terms)), F.lit(0.0))

    def plain(array):
        place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
        return F.array_sort(F.transform(array, lambda s: F.struct(
            s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))

    rows = found.withColumn("base", F.filter("spans", lambda s: s["base"]))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("spans", lambda s: ~s["base"] & (score(s) >= cut) & free(s))
    return rows.select("doc_id", plain(F.col("base")).alias("base"), plain(F.concat("base", added)).alias("spans"))


def _joined(array: str) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """One row per document: doc_id, the counts of base spans by kind, base_sha256 and spans."""
    found = candidates(docs)
    patterns = vote_patterns(found)
    weights = train(patterns, estimate(patterns)[0])
    rows = spans(found, weights, confident)
    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"),
                       _joined("spans").alias("spans"))
