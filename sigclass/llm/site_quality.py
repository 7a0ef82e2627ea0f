"""Document quality by hierarchical empirical Bayes: text evidence with host and path posteriors.

1. Evidence: an additive logistic classifier over binned document statistics, fitted on a
   bounded sample of labelled documents (``SAMPLE`` rows, a documented parameter), gives each
   document a log Bayes factor.
2. Sites: grouped sums of the documents' probabilities by (host, path) and by host. The
   spread of hosts around the global rate, and of paths around their host's, gives two prior
   strengths by the method of moments. A host's rate is shrunk toward the global one, a
   path's toward its host's; sparse sites stay near their prior.
3. Posterior: the evidence plus the log-odds of the path's rate, from which the document's
   own share is taken out.

Defined results: a null text has no words. Null hosts and null paths are sites of their own.
A document alone on its site gets the prior of the level above. Without both classes among the
labels the evidence is 0. Rows that repeat a doc_id are documents of their own. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigclass.llm.common import checked_broadcast
from sigclass.llm.quality_rules import COUNTS, features, text_counts
from sigclass.session import materialize, ship_package

#: Most labelled documents that enter the fit.
SAMPLE = 20_000
BINS = 10
#: A document is kept if its posterior probability of good quality is at least this.
THRESHOLD = 0.5
#: Evidence is bounded, so that no document outweighs any prior.
MOST_EVIDENCE = 12.0


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def url_path(url: Column) -> Column:
    """The first segment of a URL's path."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def _matrix(texts: list) -> np.ndarray:
    import pandas as pd
    return features(pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS))


class Evidence:
    """Additive logistic classifier: a weight for each bin of each statistic."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25):
        self.edges, self.weights, self.prior = [], None, 0.0
        if not len(y) or y.min() == y.max():
            return
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        design = np.column_stack([self._bins(x), np.ones(len(x))])
        w = np.zeros(design.shape[1])
        penalty = np.append(np.full(len(w) - 1, ridge), 1e-6)
        for _ in range(rounds):  # Newton steps of the penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            slope = design.T @ (p - y) + penalty * w
            curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w
        self.prior = float(np.log(y.mean() / (1 - y.mean())))

    def _bins(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for e, c in zip(self.edges, x.T):
            hot = np.zeros((len(x), len(e) + 1))
            hot[np.arange(len(x)), np.searchsorted(e, c, "left")] = 1
            parts.append(hot)
        return np.column_stack(parts)

    def __call__(self, texts: list) -> np.ndarray:
        """Log Bayes factor of good quality for each text."""
        if self.weights is None or not texts:
            return np.zeros(len(texts))
        odds = np.column_stack([self._bins(_matrix(texts)), np.ones(len(texts))]) @ self.weights
        return np.clip(odds - self.prior, -MOST_EVIDENCE, MOST_EVIDENCE)


def fit_evidence(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence:
    """The classifier of at most ``sample`` labels, chosen by hash; the sample is broadcast."""
    ship_package(docs.sparkSession)
    known = (labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_of"), "quality")
             .orderBy(F.xxhash64("_of", "quality"), "_of", "quality").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_of"))
    rows = rows.select(F.col("quality").cast("long").alias("quality"), F.col("text").cast("binary").alias("text"))

    def counts(batches):
        for batch in batches:
            found = list(zip(*[text_counts(t) for t in batch.column("text").to_pylist()])) or [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), *[pa.array(c, pa.int64()) for c in found]],
                                             ["quality", *COUNTS])

    schema = ", ".join(f"{c} long" for c in ["quality", *COUNTS])
    table = rows.mapInArrow(counts, schema).limit(sample).toPandas().sort_values(["quality", *COUNTS])
    return Evidence(features(table), table["quality"].to_numpy(float))


def _evidence(docs: DataFrame, model: Evidence, host: Column, path: Column) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"),
                       path.cast("string").alias("path"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "host", "path")] + [pa.array(model(batch.column("text").to_pylist()))],
                ["doc_id", "host", "path", "evidence"])

    return rows.mapInArrow(run, "doc_id long, host string, path string, evidence double")


def _strength(excess: float, within: float, freedom: float, spread: float) -> float:
    """Prior strength (in documents) from the groups' squared deviations: those expected by chance
    are ``freedom * within``; what exceeds them, over ``spread``, is the variance between groups."""
    between = (excess - freedom * within) / (within * spread) if spread > 0 and within > 0 else 0.0
    between = min(max(between, 1e-4), 0.99)
    return (1 - between) / between


def shrunk_sites(scored: DataFrame, prior: float) -> tuple[DataFrame, dict]:
    """Sums of each (host, path) and of its host, and the two prior strengths and the global rate."""
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(prior))))
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(p, 9)).alias("s"))
    paths = materialize(paths, "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    a = paths.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"),
                  F.sum(F.col("s") ** 2 / F.col("n")).alias("ss")).first()
    b = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("host_s") ** 2 / F.col("host_n")).alias("ss"),
                  F.sum(F.col("host_n").cast("double") ** 2).alias("nn")).first()
    joined = paths.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    inner = joined.agg(F.sum(F.col("n") ** 2 / F.col("host_n"))).first()[0] or 0.0
    n = a["n"] or 0
    rate = (a["s"] + 1) / (n + 2) if n else 0.5
    within = rate * (1 - rate)
    levels = {"rate": rate,
              "host": _strength((b["ss"] or 0) - n * rate ** 2, within, b["k"] - 1, n - (b["nn"] or 0) / max(n, 1) - (b["k"] - 1)),
              "path": _strength((a["ss"] or 0) - (b["ss"] or 0), within, a["k"] - b["k"], n - inner - (a["k"] - b["k"]))}
    return joined, levels


def posteriors(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = SAMPLE,
               threshold: float = THRESHOLD, model: Evidence | None = None) -> DataFrame:
    """One row per document: doc_id, evidence, host_rate, path_rate (both without the document itself),
    probability and kept. ``model`` is evidence fitted before, on other documents; without it, it is fitted
    on these."""
    model = fit_evidence(docs, labels, sample) if model is None else model
    scored = materialize(_evidence(docs, model, host, path), "evidence")
    sites, levels = shrunk_sites(scored, model.prior)
    sites = checked_broadcast(sites.withColumnsRenamed({"host": "_host", "path": "_path"}))
    rows = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    own = F.round(1 / (1 + F.exp(-(F.col("evidence") + F.lit(model.prior)))), 9)
    k, m = F.lit(levels["host"]), F.lit(levels["path"])
    bounded = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = rows.withColumn("host_rate", bounded(
        (F.col("host_s") - own + k * levels["rate"]) / (F.col("host_n") - 1 + k)))
    rows = rows.withColumn("path_rate", bounded((F.col("s") - own + m * F.col("host_rate")) / (F.col("n") - 1 + m)))
    odds = F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    rows = rows.withColumn("probability", 1 / (1 + F.exp(-odds)))
    return rows.select("doc_id", "evidence", "host_rate", "path_rate", "probability",
                       (F.col("probability") >= threshold).alias("kept"))
