"""Quality rules: fixed rules, then gradient-boosted trees over document statistics.

Statistics of every whole text come from one pass in Arrow batches. The trees are
fitted on a bounded sample of labelled documents (``SAMPLE`` rows, a documented
parameter) with monotonic constraints on chosen statistics, flattened into node
arrays, and score all documents in vectorised NumPy inside the tasks.

Defined results: a null text has no words and fails the base rules. Documents
with no label, or labels for no document, do not enter the fit; without both
classes among the labels there are no trees and the base rules decide alone.
Several labels of a document, and several documents of a label, are several training
rows. Repeated rows and ties
are judged each for itself, alike. An empty table gives no rows. Extra columns
are kept by ``keep_good`` and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigclass.session import ship_package

#: Base rules (fixed values).
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Most labelled documents that enter the fit.
SAMPLE = 20_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
          "n_digits", "n_ends", "n_distinct_words"]
COUNT_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)

#: Features of the trees and their constraint: -1 if more of it never makes a document better,
#: 1 if never worse, 0 if free.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1,
            "upper_rate": -1, "digit_rate": -1, "end_rate": 0, "distinct_rate": 0, "words_per_line": 0}

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_DROP = {k: bytes(c for c in range(256) if c not in keep) for k, keep in {
    "symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)),
    "ends": b".!?", "space": _SPACE, "follow": bytes(range(0x80, 0xC0))}.items()}


def _repeated(words: list) -> int:
    """Words that lie in a 3-word window found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    k = len(codes) + 1
    if k < 2_000_000:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # the product would not fit a long: number the pairs first
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    repeated = np.zeros(n - 2, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i:n - 2 + i] |= repeated
    return int(covered.sum())


def text_counts(text: bytes | None) -> tuple:
    """The COUNTS of one text in UTF-8."""
    text = text or b""
    words = text.split()  # splits at the six ASCII white space characters
    points = len(text) - len(text.translate(None, _DROP["follow"]))
    spaces = len(text.translate(None, _DROP["space"]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), points - spaces, len(text.translate(None, _DROP["symbols"])),
            len(lines) - len(set(lines)), _repeated(words), len(lines), len(text.translate(None, _DROP["upper"])),
            len(text.translate(None, _DROP["digits"])), len(text.translate(None, _DROP["ends"])), len(set(words)))


def _counts(keep: list):
    def run(batches):
        for batch in batches:
            found = [text_counts(t) for t in batch.column("_text").to_pylist()]
            columns = list(zip(*found)) or [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep],
                                              *[pa.array(c, pa.int64()) for c in columns]], [*keep, *COUNTS])
    return run


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(_counts(["doc_id"]), f"doc_id long, {COUNT_SCHEMA}")


def base_failed():
    return ((F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def features(counts: pd.DataFrame) -> np.ndarray:
    c = {k: counts[k].to_numpy(float) for k in COUNTS}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_ends"] / words,
        c["n_distinct_words"] / words, np.log1p(c["n_words"] / lines)])


class Trees:
    """Flattened regression trees: node arrays of all trees one after another.

    ``feature`` is -1 at a leaf; ``left`` and ``right`` are node numbers; ``value`` is the leaf's
    addition to the log-odds; ``roots`` has each tree's first node.
    """

    def __init__(self, base: float):
        self.base, self.depth, self.roots = base, 0, []
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def node(self, value: float) -> int:
        for a, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            a.append(x)
        return len(self.feature) - 1

    def frozen(self) -> "Trees":
        for k, kind in (("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32),
                        ("value", float), ("roots", np.int32)):
            setattr(self, k, np.asarray(getattr(self, k), kind))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """All rows walk all trees at once, one level a step."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return self.base + self.value[at].sum(1)


def fit_trees(x: np.ndarray, y: np.ndarray, constraints: list, trees: int = 60, depth: int = 3,
              rate: float = 0.2, bins: int = 64, least: int = 20, l2: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on binned features.

    A split on a constrained feature must put its children's values in order, and the
    midpoint of the two bounds all values below it, so each tree is monotone in it.
    """
    good = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Trees(float(np.log(good / (1 - good))))
    if not len(y) or y.min() == y.max():
        model.base = 0.0 if not len(y) else model.base
        return model.frozen()
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    score = np.full(len(y), model.base)
    model.depth = depth

    def grow(rows, g, h, level, low, high):
        sg, sh = g[rows].sum(), h[rows].sum()
        here = model.node(float(np.clip(-sg / (sh + l2), low, high)) * rate)
        if level == depth or len(rows) < 2 * least:
            score[rows] += model.value[here]
            return here
        best = (1e-6, None)
        for j, c in enumerate(constraints):
            k = len(edges[j]) + 1
            cg = np.cumsum(np.bincount(binned[rows, j], g[rows], k))[:-1]
            ch = np.cumsum(np.bincount(binned[rows, j], h[rows], k))[:-1]
            cn = np.cumsum(np.bincount(binned[rows, j], minlength=k))[:-1]
            vl = np.clip(-cg / (ch + l2), low, high)
            vr = np.clip(-(sg - cg) / (sh - ch + l2), low, high)
            gain = cg ** 2 / (ch + l2) + (sg - cg) ** 2 / (sh - ch + l2) - sg ** 2 / (sh + l2)
            gain[(cn < least) | (len(rows) - cn < least) | (c * (vr - vl) < 0)] = 0
            if len(gain) and gain.max() > best[0]:
                b = int(gain.argmax())
                best = (float(gain[b]), (j, b, float(vl[b]), float(vr[b])))
        if best[1] is None:
            score[rows] += model.value[here]
            return here
        j, b, vl, vr = best[1]
        middle = (vl + vr) / 2
        c = constraints[j]
        goes = binned[rows, j] <= b
        model.feature[here], model.threshold[here] = j, float(edges[j][b])
        model.left[here] = grow(rows[goes], g, h, level + 1, *((low, middle) if c > 0 else (middle, high) if c < 0 else (low, high)))
        model.right[here] = grow(rows[~goes], g, h, level + 1, *((middle, high) if c > 0 else (low, middle) if c < 0 else (low, high)))
        return here

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        model.roots.append(len(model.feature))
        grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf)
    return model.frozen()


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees that tell quality 1 from 0, from at most ``sample`` labels, chosen by hash.

    The sample is bounded, so it may be broadcast: only its documents are counted for the fit."""
    ship_package(docs.sparkSession)
    known = (labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_of"), "quality")
             .orderBy(F.xxhash64("_of", "quality"), "_of", "quality").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_of"))
    rows = rows.select(F.col("quality").cast("long").alias("quality"), F.col("text").cast("binary").alias("_text"))
    rows = rows.mapInArrow(_counts(["quality"]), f"quality long, {COUNT_SCHEMA}").limit(sample).toPandas()
    rows = rows.sort_values(["quality", *COUNTS])  # sums of the fit do not depend on the order of arrival
    return fit_trees(features(rows), rows["quality"].to_numpy(float), list(FEATURES.values()))


def _log_odds_cut(threshold: float) -> float:
    return float(np.log(threshold / (1 - threshold)))


def decisions(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the COUNTS, base_failed, kept. Kept are the documents that pass
    the base rules and whose quality the trees put at the threshold or above."""
    model, cut = fit_on_labels(docs, labels, sample), _log_odds_cut(threshold)

    def good(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.log_odds(features(pd.concat(columns, axis=1, keys=COUNTS))) >= cut)

    judged = statistics(docs).withColumn("base_failed", base_failed())
    judged = judged.withColumn("_good", F.pandas_udf(good, "boolean")(*COUNTS))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("_good")).drop("_good")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The documents that ``decisions`` keeps, with their own columns."""
    model, cut = fit_on_labels(docs, labels, sample), _log_odds_cut(threshold)

    def kept(texts: pd.Series) -> pd.Series:
        counts = pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS)
        failed = ((counts["n_words"] < LEAST_WORDS)
                  | (100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * counts["n_words"]))
        return pd.Series(~failed.to_numpy() & (model.log_odds(features(counts)) >= cut))

    return docs.where(F.pandas_udf(kept, "boolean")(F.col("text").cast("binary")))
