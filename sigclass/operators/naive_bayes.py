"""Multinomial naive Bayes for every session at once (M1 fit, M6 score).

Fit is one ``groupBy(calibrationid, label_idx)`` with a count and one sum per
channel — a hash aggregate with a map-side partial step, so a session of any
size is spread over all tasks. ``fit`` runs that aggregate over indexed rows;
``from_statistics`` takes the same per-class statistics when they come from
elsewhere (the training flow gets them from its single fit pass). With smoothing λ, K labels seen in the
session's training rows, N training rows and D channels:

    pi_k      = ln(n_k + λ) − ln(N + λK)
    theta_kj  = ln(s_kj + λ) − ln(S_k + λD),   S_k = Σ_j s_kj
    score_k   = Σ_j theta_kj · x_j + pi_k;   prediction = argmax, ties → lowest k

which is MLlib's ``NaiveBayes`` (multinomial) on the indexed features. A
negative, NaN or infinite feature makes the session's fit fail (MLlib
rejects such input); failed sessions get no model.

Scoring joins each packet to its session's model row (≤ K classes, one
narrow row per session) and evaluates the scores in compiled column
expressions — no Python, no shuffle beyond the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigclass.operators.joins import join_small
from sigclass.schemas import LABELS, N_CHANNELS, NB_SMOOTHING


def fit(train: DataFrame, n_channels: int = N_CHANNELS, smoothing: float = NB_SMOOTHING,
        key: str = "calibrationid", label: str = "label_idx",
        features: str = "features_idx") -> DataFrame:
    """Per (session, class): key, label_idx, n, pi, theta array<double>, ok (fit succeeded)."""
    f = F.col(features)
    sums = [F.sum(F.element_at(f, j + 1)).alias(f"s{j}") for j in range(n_channels)]
    bad = F.max(F.when(F.exists(f, lambda x: (x < 0) | F.isnan(x) | (F.abs(x) == float("inf"))),
                       1).otherwise(0)).alias("bad")
    agg = train.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"), *sums, bad)
    return from_statistics(agg, n_channels, smoothing, key, label)


def from_statistics(agg: DataFrame, n_channels: int = N_CHANNELS, smoothing: float = NB_SMOOTHING,
                    key: str = "calibrationid", label: str = "label_idx") -> DataFrame:
    """Parameters from per-class sufficient statistics (key, label, n, s0..s{D-1}, bad)."""
    w = Window.partitionBy(key)
    lam = F.lit(float(smoothing))
    s_tot = sum((F.col(f"s{j}") for j in range(n_channels)), F.lit(0.0))
    out = agg.select(
        key, label, "n",
        (F.log(F.col("n") + lam)
         - F.log(F.sum("n").over(w) + lam * F.count(F.lit(1)).over(w))).alias("pi"),
        F.array(*[F.log(F.col(f"s{j}") + lam) - F.log(s_tot + lam * n_channels)
                  for j in range(n_channels)]).alias("theta"),
        (F.max("bad").over(w) == 0).alias("ok"),
    )
    return out


def models(params: DataFrame, key: str = "calibrationid", label: str = "label_idx") -> DataFrame:
    """One row per session: key, ok, classes array<struct<label_idx, pi, theta>> sorted by label_idx."""
    return params.groupBy(key).agg(
        F.min(F.col("ok").cast("int")).cast("boolean").alias("ok"),
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("label_idx"), "pi", "theta")))
        .alias("classes"))


def class_columns(classes: str = "classes", n_classes: int = len(LABELS), n_channels: int = N_CHANNELS) -> list[Column]:
    """A model's classes as columns _theta{k}_{j}, _pi{k} and _class{k}, for the side that has one row per model: so its
    packets' expressions are short enough for a compiled method. Of a class that it does not have, pi and so the
    score are NULL."""
    out = []
    for k in range(n_classes):
        c = F.get(F.col(classes), F.lit(k))
        out += [c["pi"].alias(f"_pi{k}"), c["label_idx"].alias(f"_class{k}")]
        out += [F.coalesce(F.get(c["theta"], F.lit(j)), F.lit(0.0)).alias(f"_theta{k}_{j}") for j in range(n_channels)]
    return out


def with_prediction(rows: DataFrame, features: str | list[str], out: str, n_classes: int = len(LABELS),
                    n_channels: int = N_CHANNELS) -> DataFrame:
    """Add ``out`` = argmax_k (Σ_j theta_kj x_j + pi_k), from the columns of ``class_columns``, which are dropped; ties
    go to the lowest class index.

    Unrolled over channels and classes (both fixed), so that it is compiled; classes are
    in ascending order of label_idx. The scores are columns of their own:
    they are used twice, and one expression of all of it outgrows the size of a compiled method."""
    f = [F.get(F.col(features), F.lit(j)) for j in range(n_channels)] if isinstance(features, str) else [F.col(x) for x in features]

    def score(k):
        dot = F.col(f"_theta{k}_0") * f[0]
        for j in range(1, n_channels):
            dot = dot + F.col(f"_theta{k}_{j}") * f[j]
        return dot + F.col(f"_pi{k}")

    rows = rows.withColumns({f"_score{k}": score(k) for k in range(n_classes)})
    best = F.greatest(*[F.col(f"_score{k}") for k in range(n_classes)])  # without NULLs
    index = F.when(F.col("_score0") == best, F.col("_class0"))
    for k in range(1, n_classes):  # the first on ties
        index = index.when(F.col(f"_score{k}") == best, F.col(f"_class{k}"))
    return rows.withColumn(out, index).drop(
        *[f"{name}{k}" for k in range(n_classes) for name in ("_score", "_pi", "_class")],
        *[f"_theta{k}_{j}" for k in range(n_classes) for j in range(n_channels)])


def score(rows: DataFrame, nb_models: DataFrame, key: str = "calibrationid",
          features: str | list[str] = "features_idx", out: str = "prediction",
          broadcast: bool | None = None) -> DataFrame:
    """M6: add ``out`` (class index, double) to rows whose session has a valid model; ``features`` is an array or a column
    for each channel."""
    m = nb_models.where("ok").select(key, *class_columns("classes"))
    j = join_small(rows, m, key, "inner", broadcast=broadcast)
    return with_prediction(j, features, out)
