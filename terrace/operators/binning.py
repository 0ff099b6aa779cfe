"""Quantile and distinct-value binning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strided_sample(df: DataFrame, sample: int, n: int | None = None, row_id: str = "row_id") -> DataFrame:
    """Every stride-th row, stride = n div sample (1 at least): from `sample` to about twice as many rows."""
    n = df.count() if n is None else n
    stride = max(n // max(sample, 1), 1)
    return df if stride == 1 else df.where(F.col(row_id) % stride == 0)


def _long(df: DataFrame, features: list[str]) -> DataFrame:
    """f (place in the list), v: a row for each value; null and NaN values stand last and make no cuts."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features))))
    return df.select(values.alias("x")).select("x.f", "x.v").where(F.col("v").isNotNull() & ~F.isnan("v"))


def quantile_cuts(sample: DataFrame, features: list[str], n_bins: int) -> DataFrame:
    """f, j, cut: for j from 0 to n_bins - 2 the value at place round((j + 1) / n_bins * (m - 1)) of a feature's m sorted sample values; equal cuts are kept.

    The sample's size is bounded (strided_sample), so a feature's values are sorted in one window.
    """
    ranked = _long(sample, features).withColumn("at", F.row_number().over(Window.partitionBy("f").orderBy("v")) - 1)
    sizes = ranked.groupBy("f").agg(F.count("*").alias("m"))
    places = sizes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 2)))).withColumn("at", F.floor((F.col("j") + 1) / F.lit(float(n_bins)) * (F.col("m") - 1) + 0.5).cast("int"))
    return places.join(ranked, ["f", "at"]).select("f", "j", F.col("v").alias("cut"))


def unique_cuts(sample: DataFrame, features: list[str], n_bins: int) -> DataFrame:
    """f, j, cut: midpoints between neighbouring distinct values; if there are more than n_bins - 1, those at places ((j + 1) * count) div n_bins; if fewer, the rest infinite."""
    distinct = _long(sample, features).distinct()
    w = Window.partitionBy("f").orderBy("v")
    mid = distinct.withColumn("cut", 0.5 * (F.col("v") + F.lead("v").over(w))).withColumn("at", F.row_number().over(w) - 1)
    sizes = distinct.groupBy("f").agg((F.count("*") - 1).alias("k"))
    bound = n_bins - 1
    at = F.when(F.col("k") <= bound, F.col("j")).otherwise(F.least(F.expr(f"((j + 1) * k) div {n_bins}"), F.col("k") - 1)).cast("int")
    places = sizes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(bound - 1)))).withColumn("at", at)
    found = places.join(mid.where("cut is not null"), ["f", "at"], "left")
    return found.select("f", "j", F.when(F.col("at") < F.col("k"), F.col("cut")).otherwise(F.lit(float("inf"))).alias("cut"))


def collect_cuts(cuts: DataFrame, n_features: int, n_bins: int) -> np.ndarray:
    """The cut table on the driver, features by n_bins - 1: at most 255 numbers for a feature. A feature without values has infinite cuts."""
    out = np.full((n_features, n_bins - 1), np.inf)
    for r in cuts.collect():
        out[r.f, r.j] = r.cut
    return out


def bin_of(value: Column, cuts: list[float]) -> Column:
    """The number of cuts below the value, found by halving (a tree of comparisons that is compiled with the plan); null and NaN: 0.

    So bin > t holds exactly if value > cuts[t].
    """
    cuts = [float(c) for c in cuts if c != float("inf")]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo).cast("short")
        mid = (lo + hi) // 2
        return F.when(value > F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return F.when(value.isNull() | F.isnan(value), F.lit(0).cast("short")).otherwise(tree(0, len(cuts)))


COMPILED, MOST_COMPILED = 32, 1024
"""Cuts of a feature, and of all features, up to which binning is compiled with the plan; beyond, comparisons nest too deep for the compiler and Arrow batches are searched."""


def assign_bins(df: DataFrame, features: list[str], cuts: np.ndarray, keep: list[str] | None = None, prefix: str = "b") -> DataFrame:
    """`keep` (default: all columns) and b0, b1, ...: the bin of each feature."""
    keep = df.columns if keep is None else keep
    if cuts.shape[1] <= COMPILED and cuts.size <= MOST_COMPILED:
        return df.select(*(F.col(c) for c in keep), *(bin_of(F.col(c).cast("double"), cuts[i].tolist()).alias(f"{prefix}{i}") for i, c in enumerate(features)))
    src = df.select(*(F.col(c) for c in keep), *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(features)))
    n = len(keep)

    def run(batches):
        for b in batches:
            found = []
            for i in range(len(features)):
                v = b.column(n + i).to_numpy(zero_copy_only=False).astype(float)
                found.append(pa.array(np.where(np.isnan(v), 0, np.searchsorted(cuts[i], v, "left")).astype(np.int16)))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *found], names=[*keep, *(f"{prefix}{i}" for i in range(len(features)))])

    kept = [f"`{c}` {t}" for c, t in src.dtypes[:n]]
    return src.mapInArrow(run, ", ".join([*kept, *(f"{prefix}{i} short" for i in range(len(features)))]))


def pack4(low: Column, high: Column) -> Column:
    """Two bins under 16 in one number."""
    return low.cast("int").bitwiseOR(F.shiftleft(high.cast("int"), 4))


def unpack4(packed: Column) -> tuple[Column, Column]:
    return packed.bitwiseAND(F.lit(15)), F.shiftright(packed, 4)
