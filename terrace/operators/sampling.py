"""Row and column sampling, and hessian clamping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.hashing import hash01, hash32_of
from terrace.functions.normal import inverse_normal_cdf

HALF_NORMAL = 0.7978845608028654  # fixed value: the mean of |x| for a standard normal x, sqrt(2 / pi)
PROBES, FEW = 64, 4096


def tree_seed(seed: int, tree: int) -> int:
    return hash32_of(tree, seed)


def stride_rows(row_id: Column, subsample: float, tree: int) -> Column:
    """Every stride-th row, stride = round(1 / subsample), beginning at another one in each tree."""
    stride = int(1 / subsample + 0.5)
    return row_id % stride == tree % stride


def hash_rows(row_id: Column, subsample: float, seed: int) -> Column:
    return hash01(row_id, seed) < subsample


def kept_features(n: int, colsample: float, seed: int) -> list[int]:
    """Features whose hash is under colsample; if none is, that with the smallest hash."""
    at = {f: hash32_of(f, seed ^ 0x5A5A5A5A) / 2**32 for f in range(n)}
    return [f for f in at if at[f] < colsample] or [min(at, key=at.get)]


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column without nulls: each pass counts the values in PROBES equal parts of the interval that holds it, until few or equal values are left."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    rest = df.select(F.col(column).alias("x"))
    while lo < hi:
        width = (hi - lo) / PROBES
        inside = rest.where(F.col("x").between(lo, hi)) if width > 0 else rest
        part = F.least(F.floor((F.col("x") - lo) / F.lit(width)), F.lit(PROBES - 1))
        counts = inside.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy(F.desc("p")).collect()
        for r in counts:
            if k <= r.n:
                break
            k -= r.n
        lo, hi = r.lo, r.hi
        if r.n <= FEW:
            return sorted((x.x for x in rest.where(F.col("x").between(lo, hi)).collect()), reverse=True)[k - 1]
    return lo


def goss(df: DataFrame, top: float, other: float, seed: int, mode: str = "exact", strict: bool = False, g: str = "g", h: str = "h", row_id: str = "row_id", n: int | None = None) -> DataFrame:
    """Gradient-based one-side sampling: rows at or above a threshold of |g| stay, others with a chance, their g and h amplified by (1 - top) / other.

    exact: the threshold is the value of rank int(top * n) (1 at least), ties stay, and the chance is other / (1 - top). gaussian: the threshold is that of half-normal gradients
    with their mean, and the chance is other. strict: h becomes 1, or the factor for amplified rows.
    """
    size = F.abs(F.col(g))
    factor = (1 - top) / max(other, 1e-9)
    if mode == "exact":
        n = df.count() if n is None else n
        limit = kth_largest(df.select(size.alias("x")), "x", min(max(int(top * n), 1), n))
        chance = min(max(other / max(1 - top, 1e-9), 0.0), 1.0)
    else:
        mean = df.agg(F.avg(size)).first()[0] or 0.0
        limit, chance = mean / HALF_NORMAL * inverse_normal_cdf(1 - top / 2) if top else float("inf"), other
    w = F.when(size >= limit, 1.0).when(hash01(F.col(row_id), seed) < chance, factor)
    h_out = F.col("_w") if strict else F.col(h) * F.col("_w")
    return df.withColumn("_w", w).where("_w is not null").withColumn(g, F.col(g) * F.col("_w")).withColumn(h, h_out).drop("_w")


def clamp_hessian(df: DataFrame, p: float, h: str = "h", floor: float = 1e-6) -> DataFrame:
    """h brought within z standard deviations of its mean, z the (1 - p) quantile of the normal distribution; not below `floor`."""
    mean, var = df.agg(F.avg(h), F.var_pop(h)).first()
    if mean is None:
        return df
    spread = inverse_normal_cdf(1 - p) * max(var, 0.0) ** 0.5
    return df.withColumn(h, F.least(F.greatest(F.col(h), F.lit(max(mean - spread, floor))), F.lit(mean + spread)))
