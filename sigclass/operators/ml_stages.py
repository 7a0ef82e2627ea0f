"""Session indexing as MLlib stages, so that a whole model is one saved ``PipelineModel``.

``SessionIndexer`` fits a session's label order and channel categories and its model re-codes raw
packets; ``LabelDecoder`` turns a prediction into the session's label. Both keep what they know in
parameters, so MLlib's default writer saves and loads them, and a pipeline of them and a classifier goes
from stored packets (label, features) to label names without the registry.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigclass.functions.labels import decode, encode
from sigclass.operators import prepare
from sigclass.operators.mllib_train import feature_metadata
from sigclass.schemas import N_CHANNELS


class _Labels(Params):
    labels = Param(Params._dummy(), "labels", "label names in the order of their classes", TypeConverters.toListString)

    def getLabels(self) -> list[str]:
        return self.getOrDefault(self.labels)


class SessionIndexerModel(Model, _Labels, DefaultParamsReadable, DefaultParamsWritable):
    """Adds label_idx (if there is a label) and fv, the re-coded channels as a vector."""

    categories = Param(Params._dummy(), "categories", "JSON: channel -> its values in the order of their codes",
                       TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labels=None, categories=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def codes(self) -> dict[int, list[float]]:
        return {int(j): values for j, values in json.loads(self.getOrDefault(self.categories)).items()}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        codes = self.codes()
        none = F.lit(None).cast("map<int,map<double,double>>")
        maps = F.create_map(*[x for j, values in codes.items() for x in (
            F.lit(j), F.create_map(*[y for c, v in enumerate(values) for y in (F.lit(float(v)), F.lit(float(c)))]))]) if codes else none
        vector = array_to_vector(prepare.apply_categories("features", maps)).alias(
            "fv", metadata=feature_metadata({j: len(v) for j, v in codes.items()}, N_CHANNELS))
        out = dataset.select("*", vector)
        if "label" in dataset.columns:
            out = out.withColumn("label_idx", encode("label", F.array(*[F.lit(x) for x in self.getLabels()])))
        return out


class SessionIndexer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the label order (most frequent first, then by name) and the channel categories of one session's
    packets (calibrationid, label, features): at most three labels, and six values for each channel."""

    def _fit(self, dataset: DataFrame) -> SessionIndexerModel:
        frame = prepare.packet_frame(dataset)
        profile = prepare.session_profile(frame)
        labels = [r.label for r in prepare.label_index_fit(None, profile).orderBy("label_idx").collect()]
        codes: dict[int, list[float]] = {}
        for r in prepare.channel_index_fit(frame.where("valid"), profile=profile).orderBy("channel", "code").collect():
            codes.setdefault(r.channel, []).append(r.value)
        return SessionIndexerModel(labels=labels, categories=json.dumps(codes))


class LabelDecoder(Transformer, _Labels, DefaultParamsReadable, DefaultParamsWritable):
    """Adds predicted_label, the name of the class in ``prediction``."""

    @keyword_only
    def __init__(self, *, labels=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("predicted_label", decode("prediction", F.array(*[F.lit(x) for x in self.getLabels()])))


def registry_pipeline(row, classifier) -> PipelineModel:
    """The whole pipeline of a registry row and its loaded classifier, to be saved as one model."""
    codes = {j: [v for v, _ in sorted(m.items(), key=lambda x: x[1])] for j, m in (row["cat_maps"] or {}).items()}
    return PipelineModel([SessionIndexerModel(labels=list(row["labels"]), categories=json.dumps(codes)), classifier,
                          LabelDecoder(labels=list(row["labels"]))])


def save_whole_models(spark: SparkSession, registry: DataFrame, path: str) -> int:
    """K5: save the forests and perceptrons of registry rows as whole pipelines, ``path``/type=…/session=…; returns
    their number. MLlib saves one model a call, so this is a loop over the rows, which are streamed."""
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel, RandomForestClassificationModel
    kinds = {"rf": RandomForestClassificationModel, "mlp": MultilayerPerceptronClassificationModel}
    n = 0
    for row in registry.where(F.col("model_type").isin(*kinds)).select("model_type", "labels", "cat_maps", "model_path").toLocalIterator():
        whole = registry_pipeline(row, kinds[row["model_type"]].load(row["model_path"]))
        whole.write().overwrite().save("/".join([path.rstrip("/"), *row["model_path"].rsplit("/", 2)[1:]]))
        n += 1
    return n
