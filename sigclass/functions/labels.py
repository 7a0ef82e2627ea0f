"""Label encoding / decoding and the per-row prediction map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigclass.schemas import LABELS, MAP_KEYS, PLACEHOLDER


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decode(index: Column | str, labels: Column | str = "labels") -> Column:
    """Class index -> label name, using the session's fitted label order."""
    return F.element_at(_c(labels), _c(index).cast("int") + 1)


def encode(label: Column | str, labels: Column | str = "labels") -> Column:
    """P7 on a fitted order: label name -> class index (double), NULL if unseen."""
    return (F.nullif(F.array_position(_c(labels), _c(label)), F.lit(0)) - 1).cast("double")


def fixed_label_number(label: Column | str) -> Column:
    """P10 in the application's fixed form: Shallow 0, Medium 1, Deep 2, anything else 0."""
    m = F.create_map(*[x for i, name in enumerate(LABELS) for x in (F.lit(name), F.lit(float(i)))])
    return F.coalesce(F.element_at(m, _c(label)), F.lit(0.0))


def fixed_label_name(index: Column | str) -> Column:
    """P9 in the application's fixed form: index into Shallow, Medium, Deep."""
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), _c(index).cast("int") + 1)


def prediction_map(rf: Column | str, mlp: Column | str, nb: Column | str) -> Column:
    """Map RandomForest/MLPerceptron/NaiveBayes -> label, or the placeholder."""
    vals = {"rf": rf, "mlp": mlp, "nb": nb}
    return F.create_map(*[x for t in ("rf", "mlp", "nb")
                          for x in (F.lit(MAP_KEYS[t]), F.coalesce(_c(vals[t]), F.lit(PLACEHOLDER)))])


def is_pending(predictedlabels: Column | str = "predictedlabels") -> Column:
    """S6 predicate: any entry still holds the placeholder (or no map at all)."""
    m = _c(predictedlabels)
    return m.isNull() | F.array_contains(F.map_values(m), PLACEHOLDER)
