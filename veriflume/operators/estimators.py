"""The models as pyspark.ml stages: an Estimator, and a Model that is saved and loaded with the domain it was fitted with."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from . import modelling
from .domain import Domain
from .forest import Forest

SAVED = {"forest": Forest, "boosting": GBTRegressionModel, "ridge": LinearRegressionModel}


class _Settings(Params):
    kind = Param(Params._dummy(), "kind", "forest, boosting or ridge", TypeConverters.toString)
    names = Param(Params._dummy(), "names", "names of the features in order", TypeConverters.toListString)
    labelName = Param(Params._dummy(), "labelName", "what the label is", TypeConverters.toString)
    curation = Param(Params._dummy(), "curation", "how the labels were curated", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "of the fit", TypeConverters.toInt)
    settings = Param(Params._dummy(), "settings", "of the fit, as JSON: trees, rounds, depth", TypeConverters.toString)
    useLeverage = Param(Params._dummy(), "useLeverage", "whether the domain asks for leverage too", TypeConverters.toBoolean)


class ActivityRegressor(Estimator, _Settings, DefaultParamsWritable, DefaultParamsReadable):
    """Fits rows (id, features, label), after the refusals of modelling.fit, and with them the domain."""

    @keyword_only
    def __init__(self, *, kind="ridge", names=None, labelName="pActivity", curation="", seed=0, settings="{}", useLeverage=True):
        super().__init__()
        self._setDefault(kind="ridge", labelName="pActivity", curation="", seed=0, settings="{}", useLeverage=True)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ActivityModel:
        get = self.getOrDefault
        names = tuple(get("names")) if self.isDefined("names") else None
        fitted = modelling.fit(dataset, get("kind"), names, get("labelName"), get("curation"), get("seed"), **json.loads(get("settings")))
        return self._copyValues(ActivityModel(fitted))


class ActivityModel(Model, _Settings, MLWritable, MLReadable):
    """transform adds `prediction` and `predicted`: a quantity with its source, its uncertainty and the domain's verdict."""

    def __init__(self, fitted: modelling.Fitted | None = None):
        super().__init__()
        self._setDefault(kind="ridge", labelName="pActivity", curation="", seed=0, settings="{}", useLeverage=True)
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return modelling.predict(self.fitted, dataset, use_leverage=self.getOrDefault("useLeverage"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: ActivityModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        f = self.instance.fitted
        extra = {"fitted": {"names": list(f.names), "n_train": f.n_train, "label_mean": f.label_mean, "label_std": f.label_std, "label_name": f.label_name, "curation": f.curation, "seed": f.seed, "notes": list(f.notes), "kind": f.kind}}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=extra)
        (f.model if f.kind == "forest" else f.model.write()).save(f"{path}/regressor")
        f.domain.save(f"{path}/domain")


class _Reader(MLReader):
    def load(self, path: str) -> ActivityModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        kept = metadata["fitted"]
        model = SAVED[kept["kind"]].load(f"{path}/regressor")
        fitted = modelling.Fitted(model=model, domain=Domain.load(spark, f"{path}/domain"), names=tuple(kept.pop("names")), notes=tuple(kept.pop("notes")), **kept)
        out = ActivityModel(fitted)
        DefaultParamsReader.getAndSetParams(out, metadata)
        out._resetUid(metadata["uid"])
        return out
