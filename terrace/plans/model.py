"""The model: scoring, intervals, importance, and persistence."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.metrics import sigmoid
from terrace.operators.encoding import TargetEncoder
from terrace.params import Params

COMPILED_TREES = 5
"""Trees up to which scoring is a projection that is compiled with the plan; beyond, Arrow batches go through all trees at once."""
CELLS = 1 << 20


def leaf_of(features: list[Column], thresholds: list[float]) -> Column:
    """The leaf of an oblivious tree: bit after bit, the first level the highest; null and NaN go left."""
    out = F.lit(0)
    for x, t in zip(features, thresholds):
        x = x.cast("double")
        bit = F.when(x.isNull() | F.isnan(x), 0).when(x > F.lit(float(t)), 1).otherwise(0)
        out = out * 2 + bit
    return out


@dataclass
class Model:
    """feature, threshold, gain: trees by levels; leaf, variance: trees by leaves."""

    features: list[str]
    objective: str
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    gain: np.ndarray
    variance: np.ndarray
    encoder: TargetEncoder | None = None
    params: Params = field(default_factory=Params)
    profile: dict[str, float] = field(default_factory=dict)

    @property
    def n_trees(self) -> int:
        return len(self.feature)

    def validate(self, df: DataFrame) -> None:
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing: {missing}")

    def encoded(self, df: DataFrame) -> DataFrame:
        return self.encoder.transform(df) if self.encoder and self.encoder.features else df

    def margin(self, upto: int | None = None) -> Column:
        """The raw score of encoded features as one expression; for few trees."""
        out = F.lit(self.base)
        for f, t, leaf in list(zip(self.feature, self.threshold, self.leaf))[:upto]:
            at = leaf_of([F.col(self.features[i]) for i in f], t)
            out = out + F.element_at(F.array(*map(F.lit, leaf.tolist())), at + 1)
        return out

    def _arrays(self, df: DataFrame, values: list[tuple[str, np.ndarray, float]]) -> DataFrame:
        """df and, for each (name, leaf values, start), start plus the sum of the values of a row's leaves."""
        n = len(df.columns)
        src = df.select(*(F.col(c) for c in df.columns), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.features)))
        arrays = (self.feature, self.threshold, [v for _, v, _ in values], [s for _, _, s in values])
        shared = df.sparkSession.sparkContext.broadcast(arrays)  # trees * (2 ** depth + 2 * depth) numbers, whatever the data
        names = [*df.columns, *(name for name, _, _ in values)]

        def run(batches):
            feature, threshold, leaves, starts = shared.value
            trees, depth = feature.shape
            for b in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[n:]]) if b.num_columns > n else np.zeros((b.num_rows, 0))
                found = [np.full(b.num_rows, s) for s in starts]
                for lo in range(0, b.num_rows, max(1, CELLS // trees)):
                    part = x[lo : lo + max(1, CELLS // trees)]
                    at = np.zeros((len(part), trees), np.int64)
                    for d in range(depth):
                        at = at * 2 + (part[:, feature[:, d]] > threshold[:, d])  # NaN is never greater
                    for out, leaf in zip(found, leaves):
                        out[lo : lo + len(part)] += leaf[np.arange(trees), at].sum(1)
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *map(pa.array, found)], names=names)

        kinds = [f"`{c}` {t}" for c, t in df.dtypes] + [f"`{name}` double" for name, _, _ in values]
        return src.mapInArrow(run, ", ".join(kinds))

    def transform(self, df: DataFrame, score: str = "score") -> DataFrame:
        """df and its raw score (the margin for logistic). A projection row by row, without a shuffle, so it scores streams too."""
        self.validate(df)
        x = self.encoded(df)
        extra = [c for c in df.columns if c not in self.features or not self.encoder or c not in self.encoder.features]
        if self.n_trees <= COMPILED_TREES:
            scored = x.withColumn(score, self.margin())
        else:
            scored = self._arrays(x, [(score, self.leaf, self.base)])
        return scored.select(*extra, score) if self.encoder and self.encoder.features else scored

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df, score, probability ([1 - p, p]) and prediction (1 if p is 0.5 or more); for l2 prediction alone, the score."""
        out = self.transform(df)
        if self.objective == "l2":
            return out.withColumn("prediction", F.col("score"))
        p = sigmoid(F.col("score"))
        return out.withColumn("probability", F.array(1 - p, p)).withColumn("prediction", F.when(p >= 0.5, 1.0).otherwise(0.0))

    def predict_interval(self, df: DataFrame, z: float = 1.96) -> DataFrame:
        """df, score, sigma (the root of the summed variances of its leaves), low and high."""
        self.validate(df)
        out = self._arrays(self.encoded(df), [("score", self.leaf, self.base), ("_var", self.variance, 0.0)])
        out = out.withColumn("sigma", F.sqrt("_var")).drop("_var")
        return out.withColumn("low", F.col("score") - z * F.col("sigma")).withColumn("high", F.col("score") + z * F.col("sigma"))

    def splits(self, spark: SparkSession) -> DataFrame:
        rows = [(t, d, int(self.feature[t, d]), float(self.threshold[t, d]), float(self.gain[t, d])) for t in range(self.n_trees) for d in range(self.feature.shape[1])]
        return spark.createDataFrame(rows, "tree int, level int, feature int, threshold double, gain double")

    def leaves(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, float(self.leaf[t, i]), float(self.variance[t, i])) for t in range(self.n_trees) for i in range(self.leaf.shape[1])]
        return spark.createDataFrame(rows, "tree int, leaf int, value double, variance double")

    def importance(self, spark: SparkSession) -> DataFrame:
        """feature (name), gain (sum of positive gains), splits; the largest gain first."""
        names = F.array(*map(F.lit, self.features))
        by = self.splits(spark).groupBy("feature").agg(F.sum(F.greatest("gain", F.lit(0.0))).alias("gain"), F.count("*").alias("splits"))
        return by.orderBy(F.desc("gain"), "feature").select(F.get(names, F.col("feature")).alias("feature"), "gain", "splits")

    def save(self, spark: SparkSession, path: str) -> None:
        """Parquet tables splits, leaves, encoders (ordered by feature and key) and meta below path."""
        self.splits(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/splits")
        self.leaves(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/leaves")
        encoder = self.encoder
        table = encoder.table.select("feature", "key", "value") if encoder else spark.createDataFrame([], "feature string, key long, value double")
        table.orderBy("feature", "key").write.mode("overwrite").parquet(f"{path}/encoders")
        meta = {"features": self.features, "objective": self.objective, "base": self.base, "params": asdict(self.params), "categorical": encoder.features if encoder else [], "mean": encoder.mean if encoder else 0.0, "buckets": encoder.buckets if encoder else 0}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
        splits, leaves = spark.read.parquet(f"{path}/splits").toPandas(), spark.read.parquet(f"{path}/leaves").toPandas()
        trees = int(splits.tree.max()) + 1
        by = lambda t, order, c, kind: t.sort_values(order)[c].to_numpy(kind).reshape(trees, -1)
        encoder = TargetEncoder(meta["categorical"], meta["mean"], spark.read.parquet(f"{path}/encoders"), meta["buckets"]) if meta["categorical"] else None
        known = {f.name for f in fields(Params)}
        return Model(
            meta["features"], meta["objective"], meta["base"], by(splits, ["tree", "level"], "feature", np.int64), by(splits, ["tree", "level"], "threshold", float), by(leaves, ["tree", "leaf"], "value", float),
            by(splits, ["tree", "level"], "gain", float), by(leaves, ["tree", "leaf"], "variance", float), encoder, Params(**{k: v for k, v in meta["params"].items() if k in known}),
        )
