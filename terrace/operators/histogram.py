"""Gradient histograms by (node, feature, bin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(df: DataFrame, bins: list[str], features: list[int] | None = None, node: str = "node", g: str = "g", h: str = "h", scale: float | None = None) -> DataFrame:
    """node, f, b, g, h, n: sums over the rows of each node's bins; absent cells are 0. Partial sums are made before the shuffle, which carries cells, not rows.

    scale: gradients are rounded to multiples of 1 / scale and summed as integers, so the result depends on no order.
    """
    features = list(range(len(bins))) if features is None else features
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(b).cast("int").alias("b")) for f, b in zip(features, bins))))
    if scale:
        total = lambda c: F.sum(F.round(F.col(c) * scale).cast("long"))
        return df.select(node, g, h, cells.alias("c")).groupBy(node, "c.f", "c.b").agg((total(g) / scale).alias("g"), (total(h) / scale).alias("h"), F.count("*").alias("n"))
    return df.select(node, g, h, cells.alias("c")).groupBy(node, "c.f", "c.b").agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count("*").alias("n"))


def build_grouping_sets(df: DataFrame, bins: list[str], node: str = "node", g: str = "g", h: str = "h") -> DataFrame:
    """As build, by one GROUPING SETS clause over (node, bin of each feature)."""
    sets = ", ".join(f"({node}, {b})" for b in bins)
    f = "CASE " + " ".join(f"WHEN grouping({b}) = 0 THEN {i}" for i, b in enumerate(bins)) + " END"
    b = "CASE " + " ".join(f"WHEN grouping({x}) = 0 THEN {x}" for x in bins) + " END"
    view = df.select(node, g, h, *bins)
    return view.sparkSession.sql(f"SELECT {node}, {f} AS f, CAST({b} AS INT) AS b, sum({g}) AS g, sum({h}) AS h, count(*) AS n FROM {{t}} GROUP BY GROUPING SETS ({sets})", t=view)


def subtract(parent: DataFrame, odd: DataFrame) -> DataFrame:
    """The histogram of all children from that of their parents and of the odd children: even = parent - odd. A cell that odd has not stays as it is."""
    o = odd.select((F.col("node") - 1).alias("_even"), F.col("f").alias("_f"), F.col("b").alias("_b"), F.col("g").alias("_g"), F.col("h").alias("_h"), F.col("n").alias("_n"))
    p = parent.withColumn("node", F.col("node") * 2)
    even = p.join(o, (p.node == o._even) & (p.f == o._f) & (p.b == o._b), "left")
    even = even.select("node", "f", "b", *((F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in "ghn")).where("n > 0")
    return even.unionByName(odd.select("node", "f", "b", "g", "h", "n"))


def dense(hist: DataFrame, nodes: int, features: int, n_bins: int) -> DataFrame:
    """hist with all cells; absent ones are 0. nodes * features * n_bins rows, whatever the data."""
    spark = hist.sparkSession
    grid = spark.range(nodes * features * n_bins).select((F.expr(f"cast(id div {features * n_bins} as int)")).alias("node"), F.expr(f"cast((id div {n_bins}) % {features} as int)").alias("f"), (F.col("id") % n_bins).cast("int").alias("b"))
    return grid.join(hist, ["node", "f", "b"], "left").select("node", "f", "b", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in "gh"))
