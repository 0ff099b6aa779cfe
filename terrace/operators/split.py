"""Split search: prefix sums, gains and the best split of a level."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix(grid: DataFrame) -> DataFrame:
    """A dense histogram with gl, hl (sums of bins up to b) and gt, ht (of all bins) of its node and feature."""
    every = Window.partitionBy("node", "f")
    upto = every.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.select("node", "f", "b", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(every).alias("gt"), F.sum("h").over(every).alias("ht"))


def gains(sums: DataFrame, n_bins: int, l2: float = 1.0, min_child: float = 1e-3, feasibility: str = "each", monotone: dict[int, int] | None = None) -> DataFrame:
    """f, b, gain of each candidate (rows with bin > b go right; b under n_bins - 1), over all nodes of the level.

    A node counts if both sides have min_child hessian (feasibility each), or every node counts if any has (any; else the gain is -1e30). monotone: by feature 1 or -1; a candidate
    whose weights over all nodes are in the other order has gain -1e30.
    """

    def term(g: Column, h: Column) -> Column:
        return F.coalesce(F.try_divide(g * g, h + l2), F.lit(0.0))

    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    ok = (F.col("hl") >= min_child) & (hr >= min_child)
    gain = term(F.col("gl"), F.col("hl")) + term(gr, hr) - term(F.col("gt"), F.col("ht"))
    total = F.sum(F.when(ok, gain).otherwise(0.0)) if feasibility == "each" else F.when(F.max(ok), F.sum(gain)).otherwise(-1e30)
    out = sums.where(F.col("b") < n_bins - 1).groupBy("f", "b").agg(total.alias("gain"), *(F.sum(c).alias(f"_{n}") for n, c in (("gl", F.col("gl")), ("hl", F.col("hl")), ("gr", gr), ("hr", hr))))
    if monotone:
        weight = lambda s: F.coalesce(F.try_divide(-F.col(f"_g{s}"), F.col(f"_h{s}") + l2), F.lit(0.0))
        sign = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in monotone.items() for x in kv)), F.col("f")), F.lit(0))
        wrong = ((sign > 0) & (weight("l") > weight("r"))) | ((sign < 0) & (weight("l") < weight("r")))
        out = out.withColumn("gain", F.when(wrong, F.lit(-1e30)).otherwise(F.col("gain")))
    return out.select("f", "b", "gain")


def best(candidates: DataFrame) -> DataFrame:
    """The candidate with the largest gain; of equal ones the lowest feature, then the lowest bin."""
    return candidates.orderBy(F.desc("gain"), "f", "b").limit(1)


def best_of_arrays(g: np.ndarray, h: np.ndarray, l2: float, min_child: float, feasibility: str = "each", monotone: np.ndarray | None = None, allowed: np.ndarray | None = None) -> tuple[int, int, float]:
    """best(gains(prefix(...))) of dense arrays [node, feature, bin]: feature, bin, gain. For cells that fit the driver."""
    gl, hl = np.cumsum(g, 2)[:, :, :-1], np.cumsum(h, 2)[:, :, :-1]
    gt, ht = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
    gr, hr = gt - gl, ht - hl

    def term(a, b):
        return np.divide(a * a, b + l2, out=np.zeros(np.broadcast(a, b).shape), where=(b + l2) != 0)

    ok = (hl >= min_child) & (hr >= min_child)
    gain = term(gl, hl) + term(gr, hr) - term(gt, ht)
    total = np.where(ok, gain, 0).sum(0) if feasibility == "each" else np.where(ok.any(0), gain.sum(0), -1e30)
    if monotone is not None and monotone.any():
        weight = lambda a, b: np.divide(-a.sum(0), b.sum(0) + l2, out=np.zeros(a.shape[1:]), where=(b.sum(0) + l2) != 0)
        left, right, sign = weight(gl, hl), weight(gr, hr), monotone[:, None]
        total = np.where(((sign > 0) & (left > right)) | ((sign < 0) & (left < right)), -1e30, total)
    if allowed is not None:
        total = np.where(allowed[:, None], total, -np.inf)
    at = int(np.argmax(total))  # the first of equal ones, in order of feature and bin
    return at // total.shape[1], at % total.shape[1], float(total.ravel()[at])
