"""Evaluation metrics as one-row DataFrames, in one aggregation each (AUC: in ranges of the score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.storage import bucket_offsets, range_bucket

CLAMP = 1e-7


def sigmoid(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def logloss_of(y: Column, margin: Column) -> Column:
    p = F.least(F.greatest(sigmoid(margin), F.lit(CLAMP)), F.lit(1 - CLAMP))
    return F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))


def accuracy_of(y: Column, margin: Column) -> Column:
    return F.avg(F.when((margin > 0) == (y > 0.5), 1.0).otherwise(0.0))


def rmse_of(y: Column, pred: Column) -> Column:
    return F.sqrt(F.avg((pred - y) * (pred - y)))


def mae_of(y: Column, pred: Column) -> Column:
    return F.avg(F.abs(pred - y))


def r2_of(y: Column, pred: Column) -> Column:
    """NaN if y is constant."""
    sst = F.regr_syy(y, y)
    return F.when(sst == 0, F.lit(float("nan"))).otherwise(1 - F.sum((pred - y) * (pred - y)) / F.when(sst != 0, sst))


def coverage_of(y: Column, pred: Column, sigma: Column, z: float = 1.96) -> Column:
    """The share of rows within z sigma of their prediction."""
    return F.avg(F.when(F.abs(pred - y) <= z * sigma, 1.0).otherwise(0.0))


def average_ranks(df: DataFrame, score: str, label: str, buckets: int | None = None) -> DataFrame:
    """score, n, n_pos and rank (from 1, averaged over ties) of each distinct score. Scores are ranked in ranges whose counts are summed first, so no task holds them all."""
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.when(F.col(label) > 0.5, 1).otherwise(0)).alias("n_pos"))
    by = by.withColumn("bucket", range_bucket(by, "score", buckets))
    w = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("n").over(w), F.lit(0))
    return by.withColumn("inner", inner).join(bucket_offsets(by, "bucket", {"base": "n"}), "bucket").select("score", "n", "n_pos", (F.col("base") + F.col("inner") + (F.col("n") + 1) / 2).alias("rank"))


def auc(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """auc by average ranks; NaN if one class is absent."""
    pos, neg = F.sum("n_pos").cast("double"), F.sum(F.col("n") - F.col("n_pos")).cast("double")
    area = F.try_divide(F.sum(F.col("n_pos") * F.col("rank")) - pos * (pos + 1) / 2, pos * neg)
    return average_ranks(df, score, label).agg(F.coalesce(area, F.lit(float("nan"))).alias("auc"))


def evaluate(df: DataFrame, objective: str, score: str = "score", label: str = "y") -> dict[str, float]:
    """auc, logloss, accuracy of raw margins, or rmse, mae, r2."""
    y, s = F.col(label).cast("double"), F.col(score)
    if objective == "logistic":
        row = df.agg(logloss_of(y, s).alias("logloss"), accuracy_of(y, s).alias("accuracy")).first()
        return {"auc": auc(df, score, label).first().auc, "logloss": row.logloss, "accuracy": row.accuracy}
    row = df.agg(rmse_of(y, s).alias("rmse"), mae_of(y, s).alias("mae"), r2_of(y, s).alias("r2")).first()
    return row.asDict()
