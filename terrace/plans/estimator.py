"""Estimators over DataFrames."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession

from terrace.functions.metrics import evaluate
from terrace.params import Params
from terrace.plans.model import Model
from terrace.plans.trainer import Trainer


class _Estimator:
    objective = "l2"

    def __init__(self, features: list[str], label: str = "y", row_id: str | None = None, order_by: list[str] | None = None, params: Params | None = None, **options):
        """options: fields of Params. Naming categorical features also bins by distinct values."""
        known = {f.name for f in fields(Params)}
        if set(options) - known:
            raise TypeError(f"no such parameters: {sorted(set(options) - known)}")
        self.features, self.label, self.row_id, self.order_by = features, label, row_id, order_by
        self.params = replace(params or Params(), objective=self.objective, **options)
        if self.params.categorical:
            self.params = replace(self.params, unique_bins=True)
        self.model: Model | None = None

    def fit(self, df: DataFrame) -> _Estimator:
        self.model = Trainer(self.params, self.features, self.label, self.row_id, self.order_by).fit(df)
        return self

    def _fitted(self) -> Model:
        if self.model is None:
            raise ValueError("fit or load first")
        return self.model

    def transform(self, df: DataFrame) -> DataFrame:
        return self._fitted().transform(df)

    def predict(self, df: DataFrame) -> DataFrame:
        return self._fitted().predict_proba(df)

    def predict_interval(self, df: DataFrame, z: float = 1.96) -> DataFrame:
        return self._fitted().predict_interval(df, z)

    def evaluate(self, df: DataFrame) -> dict[str, float]:
        return evaluate(self.transform(df), self.objective, "score", self.label)

    def feature_importance(self, spark: SparkSession) -> DataFrame:
        return self._fitted().importance(spark)

    def save(self, spark: SparkSession, path: str) -> None:
        self._fitted().save(spark, path)


class Regressor(_Estimator):
    objective = "l2"


class Classifier(_Estimator):
    objective = "logistic"

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self._fitted().predict_proba(df)


def load(spark: SparkSession, path: str) -> _Estimator:
    """A saved estimator; its kind is read from the model."""
    model = Model.load(spark, path)
    out = (Classifier if model.objective == "logistic" else Regressor)(model.features, params=model.params)
    out.model = model
    return out
