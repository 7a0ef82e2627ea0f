"""Golden test: the three published reports (matrix -> every metric line)."""

import math

import pytest
from pyspark.sql import functions as F

from sigclass.operators import metrics

# Published confusion matrices (actual row x predicted column) and report lines.
REPORTS = {
    "rf": {
        "matrix": [[63292, 4339, 0], [39105, 7301, 0], [17279, 1054, 0]],
        "accuracy": 0.5333005968119665,
        "class": {
            0.0: (0.5288612587319095, 0.9358430305629075, 0.6758103007362245, 0.8709433262793679),
            1.0: (0.5751536158815188, 0.15732879369047106, 0.24707275803722506, 0.06273556372434973),
            2.0: (0.0, 0.0, 0.0, 0.0),
        },
        "weighted": (0.4718440317888912, 0.5333005968119664, 0.43190590661454303,
                     0.4669794868156841, 0.5333005968119664),
    },
    "mlp": {
        "matrix": [[67825, 0, 0], [46256, 0, 0], [18340, 0, 0]],
        "accuracy": 0.5121921749571443,
        "class": {
            0.0: (0.5121921749571443, 1.0, 0.6774167773638425, 1.0),
            1.0: (0.0, 0.0, 0.0, 0.0),
            2.0: (0.0, 0.0, 0.0, 0.0),
        },
        "weighted": (0.2623408240873299, 0.5121921749571443, 0.3469675725504461,
                     0.5121921749571443, 0.5121921749571443),
    },
    "nb": {
        "matrix": [[2453, 24342, 41030], [871, 19156, 26229], [464, 6622, 11254]],
        "accuracy": 0.24817060738100452,
        "class": {
            0.0: (0.6475712777191129, 0.036166605234058236, 0.06850711463002528, 0.02066691436002229),
            1.0: (0.3822027134876297, 0.41413005880318227, 0.39752635510915574, 0.3593570475250972),
            2.0: (0.14333931960312304, 0.6136314067611778, 0.23239342095753357, 0.5895723214207449),
        },
        "weighted": (0.4850403919914811, 0.24817060738100455, 0.2061347480540982,
                     0.21776689068686894, 0.24817060738100455),
    },
}


def _pairs(spark):
    rows = []
    for model, rep in REPORTS.items():
        for a, row in enumerate(rep["matrix"]):
            for p, n in enumerate(row):
                if n:
                    rows.append(("u1", model, float(a), float(p), n))
    df = spark.createDataFrame(rows, "calibrationid string, model string, actual double, predicted double, n int")
    # expand each cell to n pair rows
    return df.select("calibrationid", "model", "actual", "predicted",
                     F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_")).drop("_")


@pytest.fixture(scope="module")
def pairs(spark):
    return _pairs(spark).cache()


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


def test_confusion_matrix(pairs):
    got = {(r["model"], r["actual"], r["predicted"]): r["n"]
           for r in metrics.confusion_matrix(pairs).collect()}
    for model, rep in REPORTS.items():
        for a, row in enumerate(rep["matrix"]):
            for p, n in enumerate(row):
                assert got[(model, float(a), float(p))] == n


def test_class_metrics(pairs):
    for r in metrics.class_metrics(pairs).collect():
        exp = REPORTS[r["model"]]["class"][r["class"]]
        assert close(r["precision"], exp[0]), (r, exp)
        assert close(r["recall"], exp[1])
        assert close(r["f1"], exp[2])
        assert close(r["fpr"], exp[3])
        assert close(r["tpr"], exp[1])


def test_weighted_and_accuracy(pairs):
    for r in metrics.weighted_metrics(pairs).collect():
        rep = REPORTS[r["model"]]
        assert close(r["accuracy"], rep["accuracy"])
        got = (r["weighted_precision"], r["weighted_recall"], r["weighted_f1"],
               r["weighted_fpr"], r["weighted_tpr"])
        for g, e in zip(got, rep["weighted"]):
            assert close(g, e), (r["model"], got, rep["weighted"])
        # invariant: weighted recall equals accuracy
        assert close(r["weighted_recall"], r["accuracy"])
    for r in metrics.accuracy_and_error(pairs).collect():
        assert close(r["accuracy"], REPORTS[r["model"]]["accuracy"])
        assert close(r["test_error"], 1.0 - REPORTS[r["model"]]["accuracy"])


def test_report_rows(pairs):
    rep = metrics.report(pairs)
    # 15 class lines + accuracy + 5 weighted lines per model
    counts = {r["model"]: r["c"] for r in rep.groupBy("model").agg(F.count("*").alias("c")).collect()}
    assert counts == {"rf": 21, "mlp": 21, "nb": 21}


def test_single_class_and_predicted_only(spark):
    df = spark.createDataFrame(
        [("s", "nb", 0.0, 0.0), ("s", "nb", 0.0, 1.0), ("s", "nb", 0.0, 0.0)],
        "calibrationid string, model string, actual double, predicted double")
    cm = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    # class 1.0 is only predicted: not a class, matrix is 1x1
    assert cm == {(0.0, 0.0): 2}
    c = metrics.class_metrics(df).collect()
    assert len(c) == 1 and c[0]["fpr"] is None and close(c[0]["precision"], 1.0)
    w = metrics.weighted_metrics(df).collect()[0]
    assert w["weighted_fpr"] is None and close(w["accuracy"], 2 / 3)
