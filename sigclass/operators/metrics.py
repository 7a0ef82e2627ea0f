"""Multiclass evaluation for many (session, model) groups in one plan.

Input: prediction pairs with group columns plus ``actual`` and ``predicted``
(class numbers as doubles). Semantics are those of MLlib's
``MulticlassMetrics``:

* classes of a group = its distinct *actual* values, ascending; a value that is
  only predicted is not a class (it still counts as a false positive);
* confusion matrix = actual (row) × predicted (column) over those classes;
* precision = tp / predicted (0 when nothing was predicted as the class),
  recall = tpr = tp / actual, F1 = 2pr / (p + r) (0 when p + r = 0),
  FPR = (predicted − tp) / (total − actual);
* weighted metric = Σ_class metric × actual / total; accuracy = Σ tp / total.

One deviation, the same in query and oracle: a group whose rows all belong
to one class has FPR denominator 0; MLlib reports NaN, we report NULL.

Plan: pairs are reduced to confusion cells with a partial (map-side)
aggregate — the only shuffle that sees all pairs. Everything after works on
at most classes² cells per group: the cells of a group are gathered into
one row and the per-class numbers come from higher-order functions, so
class and weighted metrics need no further shuffle of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigclass.schemas import CLASS_METRICS, WEIGHTED_METRICS

DEFAULT_KEYS = ("calibrationid", "model")


def cells(pairs: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """Non-zero confusion cells: keys, actual, predicted, n."""
    return pairs.groupBy(*keys, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _grouped(pairs: DataFrame, keys) -> DataFrame:
    c = cells(pairs, keys)
    g = c.groupBy(*keys).agg(F.collect_list(F.struct("actual", "predicted", "n")).alias("cells"))
    return g.withColumn(
        "classes", F.array_sort(F.array_distinct(F.transform("cells", lambda e: e["actual"])))
    ).withColumn(
        "total", F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, e: a + e["n"]))


def _sum_n(cells_col, pred) -> F.Column:
    return F.aggregate(F.filter(cells_col, pred), F.lit(0).cast("bigint"), lambda a, e: a + e["n"])


def confusion_matrix(pairs: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """A4: dense matrix in long form: keys, actual, predicted, n (zeros included), classes ascending."""
    g = _grouped(pairs, keys)
    rows = g.select(*keys, "cells", F.explode("classes").alias("actual"), "classes")
    rows = rows.select(*keys, "cells", "actual", F.explode("classes").alias("predicted"))
    return rows.select(
        *keys, "actual", "predicted",
        _sum_n(F.col("cells"), lambda e: (e["actual"] == F.col("actual"))
               & (e["predicted"] == F.col("predicted"))).alias("n"))


def class_metrics(pairs: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """Keys, class, n_actual, n_predicted, tp, precision, recall, f1, fpr, tpr."""
    g = _grouped(pairs, keys)
    r = g.select(*keys, "cells", "total", F.explode("classes").alias("class"))
    r = r.select(
        *keys, "class", "total",
        _sum_n(F.col("cells"), lambda e: e["actual"] == F.col("class")).alias("n_actual"),
        _sum_n(F.col("cells"), lambda e: e["predicted"] == F.col("class")).alias("n_predicted"),
        _sum_n(F.col("cells"), lambda e: (e["actual"] == F.col("class"))
               & (e["predicted"] == F.col("class"))).alias("tp"))
    p = F.when(F.col("n_predicted") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("n_predicted"))
    rec = F.col("tp") / F.col("n_actual")
    r = r.withColumn("precision", p).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    fpr = (F.col("n_predicted") - F.col("tp")) / F.nullif(F.col("total") - F.col("n_actual"), F.lit(0))
    return r.withColumn("f1", f1).withColumn("fpr", fpr).withColumn("tpr", F.col("recall"))


def weighted_metrics(pairs: DataFrame, keys=DEFAULT_KEYS, per_class: DataFrame | None = None) -> DataFrame:
    """Keys, n, accuracy, test_error, weighted precision/recall/f1/fpr/tpr."""
    c = per_class if per_class is not None else class_metrics(pairs, keys)
    share = F.col("n_actual") / F.col("total")
    return c.groupBy(*keys).agg(
        F.max("total").alias("n"),
        (F.sum("tp") / F.max("total")).alias("accuracy"),
        F.sum(F.col("precision") * share).alias("weighted_precision"),
        F.sum(F.col("recall") * share).alias("weighted_recall"),
        F.sum(F.col("f1") * share).alias("weighted_f1"),
        F.sum(F.col("fpr") * share).alias("weighted_fpr"),
        F.sum(F.col("tpr") * share).alias("weighted_tpr"),
    ).withColumn("test_error", 1.0 - F.col("accuracy"))


def accuracy_and_error(pairs: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """A5 + P13: keys, n, correct, accuracy, test_error — one partial aggregate."""
    g = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("actual") == F.col("predicted")).cast("bigint")).alias("correct"))
    return g.withColumn("accuracy", F.col("correct") / F.col("n")).withColumn(
        "test_error", 1.0 - F.col("correct") / F.col("n"))


def report(pairs: DataFrame, keys=DEFAULT_KEYS, trained_at=None) -> DataFrame:
    """K6: the report as a table — keys, metric, class (NULL for overall), value.

    One row per line of the text report: accuracy, then five metrics per
    class, then five weighted metrics. ``trained_at`` (a column or literal)
    is attached when given.
    """
    per_class = class_metrics(pairs, keys)
    w = weighted_metrics(pairs, keys, per_class)
    cls = per_class.select(*keys, "class", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in CLASS_METRICS])).alias("mv"))
    cls = cls.select(*keys, F.col("mv.metric").alias("metric"), "class", F.col("mv.value").alias("value"))
    names = ["accuracy", *WEIGHTED_METRICS]
    ov = w.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]))
        .alias("mv"))
    ov = ov.select(*keys, F.col("mv.metric").alias("metric"), F.lit(None).cast("double").alias("class"),
                   F.col("mv.value").alias("value"))
    out = cls.unionByName(ov)
    if trained_at is not None:
        out = out.withColumn("trained_at", trained_at)
    return out

