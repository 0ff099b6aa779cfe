"""Target encoding of categorical features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.hashing import category_key


@dataclass
class TargetEncoder:
    """table: feature, key, value: the smoothed mean of y of each category, over all training rows; a category that isn't there gets the global mean."""

    features: list[str]
    mean: float
    table: DataFrame
    buckets: int = 0

    @staticmethod
    def stats(df: DataFrame, features: list[str], y: str, folds: int, buckets: int = 0, row_id: str = "row_id") -> DataFrame:
        """feature, key, fold, s, n: sums and counts of y by category and fold (row_id mod folds): one aggregation over all features, partial sums first, so a hot category is no hot task."""
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), category_key(F.col(c), buckets).alias("key")) for c in features)))
        rows = df.select(pairs.alias("p"), (F.col(row_id) % folds).cast("int").alias("fold"), F.col(y).cast("double").alias("y"))
        return rows.groupBy("p.feature", "p.key", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))

    @staticmethod
    def fit(df: DataFrame, features: list[str], y: str, smoothing: float = 10.0, buckets: int = 0, mean: float | None = None) -> TargetEncoder:
        mean = df.agg(F.avg(F.col(y).cast("double"))).first()[0] if mean is None else mean
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), category_key(F.col(c), buckets).alias("key")) for c in features)))
        by = df.select(pairs.alias("p"), F.col(y).cast("double").alias("y")).groupBy("p.feature", "p.key").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
        return TargetEncoder(list(features), mean, by.select("feature", "key", ((F.col("s") + smoothing * mean) / (F.col("n") + smoothing)).alias("value")), buckets)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the features replaced by their categories' values; a left join for each, broadcast by Spark where the table is small enough."""
        for c in self.features:
            own = self.table.where(F.col("feature") == c).select(F.col("key").alias("_key"), F.col("value").alias("_value"))
            joined = df.withColumn("_key", category_key(F.col(c), self.buckets)).join(own, "_key", "left")
            df = joined.select(*(F.coalesce("_value", F.lit(self.mean)).alias(c) if x == c else F.col(x) for x in df.columns))
        return df

    @staticmethod
    def out_of_fold(df: DataFrame, features: list[str], y: str, folds: int = 5, smoothing: float = 10.0, buckets: int = 0, mean: float | None = None, row_id: str = "row_id") -> DataFrame:
        """df with each training row's features encoded from the other folds; a category that only its own fold has gets the global mean.

        Statistics are aggregated by (category, fold) and joined back. Spark broadcasts them where they are small enough; beyond that the join shuffles rows by category and fold,
        and a hot category's rows come together unless adaptive execution splits them.
        """
        folds = max(folds, 2)
        mean = df.agg(F.avg(F.col(y).cast("double"))).first()[0] if mean is None else mean
        by = TargetEncoder.stats(df, features, y, folds, buckets, row_id)
        every = by.groupBy("feature", "key").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
        rest = by.join(every, ["feature", "key"]).withColumn("r", F.col("all_n") - F.col("n"))
        rest = rest.select("feature", F.col("key").alias("_key"), F.col("fold").alias("_fold"), F.when(F.col("r") > 0, (F.col("all_s") - F.col("s") + smoothing * mean) / F.when(F.col("r") > 0, F.col("r") + smoothing)).otherwise(F.lit(mean)).alias("_value"))
        for c in features:
            own = rest.where(F.col("feature") == c).drop("feature")
            joined = df.withColumn("_key", category_key(F.col(c), buckets)).withColumn("_fold", (F.col(row_id) % folds).cast("int")).join(own, ["_key", "_fold"])
            df = joined.select(*(F.col("_value").alias(c) if x == c else F.col(x) for x in df.columns))
        return df

    def rows(self) -> list[tuple]:
        return sorted(tuple(r) for r in self.table.select("feature", "key", "value").collect())

    @staticmethod
    def of_rows(spark: SparkSession, features: list[str], mean: float, rows: list[tuple], buckets: int = 0) -> TargetEncoder:
        return TargetEncoder(features, mean, spark.createDataFrame(rows, "feature string, key long, value double"), buckets)
