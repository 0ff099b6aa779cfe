"""Synthetic datasets as Spark ranges: every value is a hash of its row, so any part can be made anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.hashing import hash01

CARDINALITIES = (5, 10, 20, 50, 100)


def uniform_rows(spark: SparkSession, n: int, n_features: int, seed: int = 0, low: float = -4.0, high: float = 4.0) -> DataFrame:
    """row_id and f0, f1, ... between low and high."""
    return spark.range(n).select(F.col("id").alias("row_id"), *((hash01(F.col("id"), seed + 7919 * (i + 1)) * (high - low) + low).alias(f"f{i}") for i in range(n_features)))


def normal(column, seed: int):
    """A standard normal hash (Box and Muller)."""
    return F.sqrt(-2 * F.ln(1 - hash01(column, seed))) * F.cos(2 * 3.141592653589793 * hash01(column, seed + 1))


def regression(spark: SparkSession, n: int, n_numeric: int = 20, seed: int = 0, noise: float = 0.5) -> DataFrame:
    """row_id, numeric f0 ..., integer categories of growing cardinality after them, and y: linear in five numeric ones, an effect of each category, 0.5 * f0 * f1, and noise."""
    i = F.col("id")
    rows = spark.range(n).select(i.alias("row_id"), *(normal(i, seed + 101 * (k + 1)).alias(f"f{k}") for k in range(n_numeric)), *(F.floor(hash01(i, seed + 5003 * (k + 1)) * c).cast("double").alias(f"f{n_numeric + k}") for k, c in enumerate(CARDINALITIES)))
    y = sum((F.lit(float(k + 1) / 3) * F.col(f"f{k}") for k in range(min(5, n_numeric))), F.lit(0.0)) + 0.5 * F.col("f0") * F.col("f1")
    for k in range(len(CARDINALITIES)):
        y = y + hash01(F.col(f"f{n_numeric + k}").cast("long"), seed + 31 * (k + 1)) - 0.5
    return rows.withColumn("y", y + noise * normal(F.col("row_id"), seed + 99991))


def classification(spark: SparkSession, n: int, n_features: int = 50, informative: int = 24, flip: float = 0.02, seed: int = 0) -> DataFrame:
    """row_id, f0 ..., y (0 or 1): the sign of a sum over the informative features, with a share of labels flipped."""
    i = F.col("id")
    rows = spark.range(n).select(i.alias("row_id"), *(normal(i, seed + 211 * (k + 1)).alias(f"f{k}") for k in range(n_features)))
    side = sum((F.col(f"f{k}") * (1 if k % 2 else -1) for k in range(informative)), F.lit(0.0)) + F.col("f0") * F.col("f1")
    clean = F.when(side > 0, 1.0).otherwise(0.0)
    return rows.withColumn("y", F.when(hash01(F.col("row_id"), seed + 77) < flip, 1 - clean).otherwise(clean))
