"""The registered queries of the boosting operators, each over its whole table, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import hashing, metrics
from terrace.functions.normal import inverse_normal_cdf
from terrace.operators import binning, encoding, histogram, objective, preprocess, sampling, split
from terrace.params import Params
from terrace.plans.model import Model, leaf_of
from terrace.plans.trainer import Trainer
from terrace.storage import with_row_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def reg() -> Column:
    """A target between 0 and 1 that depends on quantity, tax and discount."""
    return F.expr("0.4 * l_quantity / 50 + CASE WHEN l_tax > 0.04 THEN 6 * l_discount ELSE 0 END")


def both() -> Column:
    """A target that is 1 for large quantities with a large discount."""
    return F.expr("CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 1.0 ELSE 0.0 END").cast("double")


CUTS = {"l_quantity": [5.0, 10, 15, 20, 25, 30, 35, 40, 45], "l_discount": [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09], "l_tax": [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07], "l_linenumber": [1.0, 2, 3, 4, 5, 6]}
BINS = 10


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the derived targets and bins by fixed cuts."""
    df = table(spark, sf_dir, "lineitem").withColumn("y", reg()).withColumn("c", both())
    return df.select("*", *(binning.bin_of(F.col(c).cast("double"), CUTS[c]).alias(f"b{i}") for i, c in enumerate(FEATURES)))


def numbered(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return with_row_id(table(spark, sf_dir, "lineitem").withColumn("y", reg()).withColumn("c", both()).select(*dict.fromkeys([*KEYS, *columns])), KEYS)


# --- the same pieces in SQL -------------------------------------------------------------------------------------------------
SQL_REG = "0.4 * l_quantity / 50 + CASE WHEN l_tax > 0.04 THEN 6 * l_discount ELSE 0 END"
SQL_AND = "CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
SQL_ITEMS = "li AS (SELECT *, (" + SQL_REG + ")::DOUBLE AS y, " + SQL_AND + " AS c, " + ", ".join(
    f"len(list_filter({CUTS[c]}::DOUBLE[], lambda q: q < {c})) AS b{i}" for i, c in enumerate(FEATURES)
) + " FROM lineitem)"
SQL_ROWS = "nr AS (SELECT *, (" + SQL_REG + ")::DOUBLE AS y, " + SQL_AND + " AS c, row_number() OVER (ORDER BY " + ", ".join(KEYS) + ") - 1 AS row_id FROM lineitem)"


def sql_cells(source: str, node: str, what: str = "sum(g) AS g, sum(h) AS h, count(*) AS n", where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT {node} AS node, {i} AS f, b{i} AS b, {what} FROM {source} WHERE {where} GROUP BY 1, 2, 3" for i in range(len(FEATURES)))


def sql_gains(cells: str, extra: str = "", ok: str = "hl >= 0.001 AND ht - hl >= 0.001", total: str = "sum(CASE WHEN ok THEN gain ELSE 0 END)") -> str:
    """CTEs dense, sums, cand from a CTE `cells`(node, f, b, g, h)."""
    return f"""
      grid AS (SELECT n.node, f.f, b.b FROM (SELECT DISTINCT node FROM {cells}) n, (SELECT unnest(range({len(FEATURES)})) AS f) f, (SELECT unnest(range({BINS})) AS b) b),
      dense AS (SELECT grid.*, coalesce(x.g, 0) AS g, coalesce(x.h, 0) AS h FROM grid LEFT JOIN {cells} x ON x.node = grid.node AND x.f = grid.f AND x.b = grid.b),
      sums AS (SELECT node, f, b, sum(g) OVER (PARTITION BY node, f ORDER BY b) AS gl, sum(h) OVER (PARTITION BY node, f ORDER BY b) AS hl,
               sum(g) OVER (PARTITION BY node, f) AS gt, sum(h) OVER (PARTITION BY node, f) AS ht FROM dense),
      part AS (SELECT *, ({ok}) AS ok, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM sums WHERE b < {BINS - 1}),
      cand AS (SELECT f, b, {total} AS gain {extra} FROM part GROUP BY f, b)"""


# --- base scores, cuts, bins ------------------------------------------------------------------------------------------------
@query(f"SELECT round(least(greatest(avg(({SQL_REG})::DOUBLE), 1e-6), 1 - 1e-6), 9) AS base FROM lineitem")
def q_base_score_l2(spark, d):
    return table(spark, d, "lineitem").agg(F.round(objective.clamped_mean(reg()), 9).alias("base"))


@query(f"SELECT round(ln(m / (1 - m)), 9) AS base FROM (SELECT least(greatest(avg({SQL_AND}), 1e-6), 1 - 1e-6) AS m FROM lineitem)")
def q_base_score_logit(spark, d):
    m = F.col("m")
    return table(spark, d, "lineitem").agg(objective.clamped_mean(both()).alias("m")).select(F.round(F.ln(m / (1 - m)), 9).alias("base"))


@query(f"WITH {SQL_ROWS} SELECT row_id, l_orderkey, l_linenumber, l_partkey FROM nr WHERE row_id % greatest((SELECT count(*) FROM lineitem) // 20000, 1) = 0")
def q_strided_sample(spark, d):
    return binning.strided_sample(numbered(spark, d, []), 20_000).select("row_id", "l_orderkey", "l_linenumber", "l_partkey")


@query("""
    WITH v AS (SELECT 0 AS f, l_extendedprice AS v FROM lineitem UNION ALL SELECT 1, l_quantity FROM lineitem),
    r AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS place, count(*) OVER (PARTITION BY f) AS m FROM v),
    j AS (SELECT unnest(range(31)) AS j)
    SELECT f, CAST(j AS INTEGER) AS j, v AS cut FROM r, j WHERE place = CAST(floor((j + 1) / 32.0::DOUBLE * (m - 1) + 0.5) AS BIGINT)""")
def q_quantile_cuts(spark, d):
    return binning.quantile_cuts(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], 32)


@query("""
    WITH v AS (SELECT DISTINCT 0 AS f, l_quantity AS v FROM lineitem UNION ALL SELECT DISTINCT 1, l_tax FROM lineitem),
    c AS (SELECT f, 0.5 * (v + lead(v) OVER (PARTITION BY f ORDER BY v)) AS cut, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS at FROM v),
    k AS (SELECT f, count(*) - 1 AS k FROM v GROUP BY f), j AS (SELECT unnest(range(31)) AS j),
    p AS (SELECT f, j, k, CASE WHEN k <= 31 THEN j ELSE least(((j + 1) * k) // 32, k - 1) END AS at FROM k, j)
    SELECT p.f, CAST(p.j AS INTEGER) AS j, CASE WHEN p.at < p.k THEN c.cut ELSE 'infinity'::DOUBLE END AS cut FROM p LEFT JOIN c ON c.f = p.f AND c.at = p.at""")
def q_unique_cuts(spark, d):
    return binning.unique_cuts(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], 32)


@query(f"WITH {SQL_ITEMS} SELECT {', '.join(KEYS)}, b0, b1, b2, b3 FROM li")
def q_bin_assign(spark, d):
    return items(spark, d).select(*KEYS, *(F.col(f"b{i}").cast("long").alias(f"b{i}") for i in range(4)))


@query(f"WITH {SQL_ITEMS} SELECT f, b, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT {i} AS f, b{i} AS b FROM li' for i in range(4))}) GROUP BY f, b")
def q_bin_counts(spark, d):
    df = items(spark, d).select(F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"b{i}").cast("long").alias("b")) for i in range(4)))).alias("x"))
    return df.groupBy("x.f", "x.b").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_ITEMS} SELECT b0 + 16 * b1 AS packed, b0 AS low, b1 AS high, count(*) AS n FROM li GROUP BY 1, 2, 3")
def q_pack4(spark, d):
    packed = items(spark, d).select(binning.pack4(F.col("b0"), F.col("b1")).cast("long").alias("packed")).groupBy("packed").agg(F.count("*").alias("n"))
    low, high = binning.unpack4(F.col("packed"))
    return packed.select("packed", low.cast("long").alias("low"), high.cast("long").alias("high"), "n")


# --- gradients --------------------------------------------------------------------------------------------------------------
MARGIN = "(l_quantity - 25) / 20 + 10 * (l_discount - 0.05)"


@query(f"SELECT {', '.join(KEYS)}, round(0.5 - ({SQL_REG})::DOUBLE, 9) AS g, 1.0::DOUBLE AS h FROM lineitem")
def q_grad_l2(spark, d):
    return table(spark, d, "lineitem").select(*KEYS, F.round(objective.gradient(reg(), F.lit(0.5), "l2"), 9).alias("g"), objective.hessian(F.lit(0.5), "l2").alias("h"))


@query(f"WITH p AS (SELECT *, {SQL_AND} AS c, 1 / (1 + exp(-({MARGIN})::DOUBLE)) AS p FROM lineitem) SELECT {', '.join(KEYS)}, round(p - c, 9) AS g, round(greatest(p * (1 - p), 1e-6), 9) AS h FROM p")
def q_grad_logistic(spark, d):
    m = F.expr(MARGIN)
    return table(spark, d, "lineitem").select(*KEYS, F.round(objective.gradient(both(), m, "logistic"), 9).alias("g"), F.round(objective.hessian(m, "logistic"), 9).alias("h"))


# --- histograms -------------------------------------------------------------------------------------------------------------
def graded(spark, d, node: str = "0") -> DataFrame:
    return items(spark, d).select("b0", "b1", "b2", "b3", F.expr(node).cast("int").alias("node"), (F.lit(0.5) - F.col("y")).alias("g"), F.lit(1.0).alias("h"))


SQL_GRADED = SQL_ITEMS + ", gr AS (SELECT *, 0.5 - y AS g, 1.0::DOUBLE AS h FROM li)"
CHILD = "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END"
BIN_NAMES = [f"b{i}" for i in range(4)]


def cells_out(df: DataFrame) -> DataFrame:
    return df.select(F.col("node").cast("int").alias("node"), F.col("f").cast("int").alias("f"), F.col("b").cast("long").alias("b"), F.round("g", 6).alias("g"), F.round("h", 6).alias("h"), "n")


@query(f"WITH {SQL_GRADED} SELECT node, f, b, round(g, 6) AS g, round(h, 6) AS h, n FROM ({sql_cells('gr', '0')})")
def q_hist_root(spark, d):
    return cells_out(histogram.build(graded(spark, d), BIN_NAMES))


@query(f"WITH {SQL_GRADED} SELECT node, f, b, g, h, n FROM ({sql_cells('gr', '0', 'sum(CAST(round(g * 16384) AS BIGINT)) / 16384.0::DOUBLE AS g, sum(CAST(round(h * 16384) AS BIGINT)) / 16384.0::DOUBLE AS h, count(*) AS n')})")
def q_hist_fixed(spark, d):
    return histogram.build(graded(spark, d), BIN_NAMES, scale=16384).select("node", "f", F.col("b").cast("long").alias("b"), "g", "h", "n")


@query(f"WITH {SQL_GRADED} SELECT node, f, b, round(g, 6) AS g, round(h, 6) AS h, n FROM ({sql_cells('gr', CHILD)})")
def q_hist_grouping_sets(spark, d):
    return cells_out(histogram.build_grouping_sets(graded_by_child(spark, d), BIN_NAMES))


def graded_by_child(spark, d) -> DataFrame:
    return items(spark, d).select("b0", "b1", "b2", "b3", F.expr(CHILD).alias("node"), (F.lit(0.5) - F.col("y")).alias("g"), F.lit(1.0).alias("h"))


@query(f"WITH {SQL_GRADED} SELECT node, f, b, round(g, 6) AS g, round(h, 6) AS h, n FROM ({sql_cells('gr', CHILD)})")
def q_hist_subtract(spark, d):
    rows = graded_by_child(spark, d)
    parent, odd = histogram.build(rows.withColumn("node", F.lit(0)), BIN_NAMES), histogram.build(rows.where("node % 2 = 1"), BIN_NAMES)
    return cells_out(histogram.subtract(parent, odd))


# --- splits -----------------------------------------------------------------------------------------------------------------
def level_sums(spark, d, rows: DataFrame, nodes: int) -> DataFrame:
    return split.prefix(histogram.dense(histogram.build(rows, BIN_NAMES), nodes, len(FEATURES), BINS))


SQL_ROOT = f"WITH {SQL_GRADED}, cells AS ({sql_cells('gr', '0')}), " + sql_gains("cells")
SQL_LEVEL2 = f"WITH {SQL_GRADED}, cells AS ({sql_cells('gr', CHILD)}), " + sql_gains("cells")


@query(SQL_ROOT + " SELECT CAST(f AS INTEGER) AS f, CAST(b AS INTEGER) AS b, round(gl, 6) AS gl, round(hl, 6) AS hl, round(gt, 6) AS gt, round(ht, 6) AS ht FROM sums")
def q_prefix_scan(spark, d):
    return level_sums(spark, d, graded(spark, d), 1).select("f", "b", *(F.round(c, 6).alias(c) for c in ("gl", "hl", "gt", "ht")))


@query(SQL_ROOT + " SELECT CAST(f AS INTEGER) AS f, CAST(b AS INTEGER) AS b, round(gain, 4) AS gain FROM cand")
def q_split_gain(spark, d):
    return split.gains(level_sums(spark, d, graded(spark, d), 1), BINS).select("f", "b", F.round("gain", 4).alias("gain"))


@query(SQL_ROOT + " SELECT CAST(f AS INTEGER) AS f, CAST(b AS INTEGER) AS b, round(gain, 4) AS gain FROM cand ORDER BY cand.gain DESC, f, b LIMIT 1")
def q_root_split(spark, d):
    return split.best(split.gains(level_sums(spark, d, graded(spark, d), 1), BINS)).select("f", "b", F.round("gain", 4).alias("gain"))


@query(SQL_LEVEL2 + " SELECT CAST(f AS INTEGER) AS f, CAST(b AS INTEGER) AS b, round(gain, 4) AS gain FROM cand ORDER BY cand.gain DESC, f, b LIMIT 1")
def q_level2_split(spark, d):
    return split.best(split.gains(level_sums(spark, d, graded_by_child(spark, d), 2), BINS)).select("f", "b", F.round("gain", 4).alias("gain"))


@query(f"WITH {SQL_GRADED}, cells AS ({sql_cells('gr', CHILD)}), " + sql_gains("cells", ok="hl >= 8000 AND ht - hl >= 8000") + " SELECT CAST(f AS INTEGER) AS f, CAST(b AS INTEGER) AS b, round(gain, 4) AS gain FROM cand")
def q_min_child(spark, d):
    return split.gains(level_sums(spark, d, graded_by_child(spark, d), 2), BINS, min_child=8000).select("f", "b", F.round("gain", 4).alias("gain"))


@query(f"WITH {SQL_GRADED}, cells AS ({sql_cells('gr', CHILD)}), " + sql_gains("cells", ok="hl >= 12000 AND ht - hl >= 12000", total="CASE WHEN bool_or(ok) THEN sum(gain) ELSE -1e30 END") + " SELECT CAST(f AS INTEGER) AS f, CAST(b AS INTEGER) AS b, round(gain, 4) AS gain FROM cand")
def q_any_node_feasible(spark, d):
    return split.gains(level_sums(spark, d, graded_by_child(spark, d), 2), BINS, min_child=12000, feasibility="any").select("f", "b", F.round("gain", 4).alias("gain"))


SQL_SIDES = ", sum(gl) AS gl, sum(hl) AS hl, sum(gt - gl) AS gr, sum(ht - hl) AS hr"


@query(f"WITH {SQL_GRADED}, cells AS ({sql_cells('gr', '0')}), " + sql_gains("cells", SQL_SIDES) + """
    SELECT CAST(f AS INTEGER) AS f, CAST(b AS INTEGER) AS b, round(CASE WHEN f = 2 AND -gl / (hl + 1) > -gr / (hr + 1) OR f IN (0, 1) AND -gl / (hl + 1) < -gr / (hr + 1) THEN -1e30 ELSE gain END, 4) AS gain FROM cand""")
def q_monotone_split(spark, d):
    return split.gains(level_sums(spark, d, graded(spark, d), 1), BINS, monotone={0: -1, 1: -1, 2: 1}).select("f", "b", F.round("gain", 4).alias("gain"))


@query(SQL_ROOT + f" SELECT CAST(f AS INTEGER) AS f, CAST(b AS INTEGER) AS b, round(gain, 4) AS gain FROM cand WHERE f IN ({', '.join(map(str, sampling.kept_features(4, 0.5, 11)))})")
def q_colsample_split(spark, d):
    kept = sampling.kept_features(4, 0.5, 11)
    hist = histogram.build(graded(spark, d), [f"b{i}" for i in kept], kept)
    sums = split.prefix(histogram.dense(hist, 1, 4, BINS)).where(F.col("f").isin(kept))
    return split.gains(sums, BINS).select("f", "b", F.round("gain", 4).alias("gain"))


# --- trees ------------------------------------------------------------------------------------------------------------------
TREE = Params(n_trees=1, depth=2, learning_rate=0.1, n_bins=BINS, objective="l2", device="cpu")


def with_fixed_cuts(spark, d, target: str, params: Params) -> Model:
    """A model of the derived target over the fixed cuts: distinct values of a table of the cuts would move them, so bins are trained on as they are."""
    rows = items(spark, d).select(*(F.col(f"b{i}").cast("double").alias(f"x{i}") for i in range(4)), F.col(target).alias("y"))
    model = Trainer(params, [f"x{i}" for i in range(4)], "y").fit(rows)
    table_of = [CUTS[c] for c in FEATURES]
    model.threshold = np.array([[table_of[f][int(t)] for f, t in zip(fs, ts)] for fs, ts in zip(model.feature, model.threshold)])
    model.features = FEATURES
    return model


def sql_tree(source: str, k: int, depth: int, y: str, logistic: bool, scale: float = 0.1) -> str:
    """CTEs of one boosting step from `source` (rows with margin m): splits chosen level by level, leaf values, and the new margins in t{k}."""
    g, h = ("1 / (1 + exp(-m)) - " + y, "greatest(1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))), 1e-6)") if logistic else (f"m - {y}", "1.0::DOUBLE")
    out, node = [f"g{k} AS (SELECT *, {g} AS g, {h} AS h, 0 AS node0 FROM {source})"], "node0"
    src = f"g{k}"
    for level in range(depth):
        n = f"{k}_{level}"
        gains = sql_gains(f"cells{n}")
        for name in ("grid", "dense", "sums", "part", "cand"):
            gains = gains.replace(f"{name} AS", f"{name}{n} AS").replace(f"FROM {name} ", f"FROM {name}{n} ").replace(f"FROM {name})", f"FROM {name}{n})").replace(f"{name}.*", f"{name}{n}.*").replace(f"= {name}.", f"= {name}{n}.")
        out.append(f"cells{n} AS ({sql_cells(src, node)})")
        out.append(gains)
        out.append(f"best{n} AS (SELECT f, b, gain FROM cand{n} ORDER BY gain DESC, f, b LIMIT 1)")
        bit = "CASE WHEN (CASE s.f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(4)) + " END) > s.b THEN 1 ELSE 0 END"
        out.append(f"s{n} AS (SELECT r.*, {node} * 2 + {bit} AS node{level + 1} FROM {src} r, best{n} s)")
        src, node = f"s{n}", f"node{level + 1}"
    out.append(f"leaf{k} AS (SELECT {node} AS leaf, -{scale} * sum(g) / (sum(h) + 1) AS value, sum(g) AS sg, sum(h) AS sh, sum(g * g) AS sg2, count(*) AS n FROM {src} GROUP BY 1)")
    plain = "b0, b1, b2, b3, y, c, " + ", ".join(KEYS)
    out.append(f"t{k} AS (SELECT {plain}, m + value AS m FROM {src} JOIN leaf{k} ON leaf{k}.leaf = {node})")
    return ", ".join(out)


def sql_boost(trees: int, depth: int, y: str, logistic: bool) -> str:
    mean = f"least(greatest(avg({y}), 1e-6), 1 - 1e-6)"
    start = f"SELECT {f'ln({mean} / (1 - {mean}))' if logistic else mean} AS base FROM li"
    plain = "b0, b1, b2, b3, y, c, " + ", ".join(KEYS)
    out = [SQL_ITEMS, f"base AS ({start})", f"t0 AS (SELECT {plain}, base AS m FROM li, base)"]
    out += [sql_tree(f"t{k}", k + 1, depth, y, logistic) for k in range(trees)]
    return "WITH " + ", ".join(out)


def splits_out(spark, model: Model, digits: int = 3) -> DataFrame:
    rows = model.splits(spark)
    cuts = [(f, b, float(v)) for f, c in enumerate(FEATURES) for b, v in enumerate(CUTS[c])]
    places = spark.createDataFrame(cuts, "feature int, b int, threshold double")
    return rows.join(F.broadcast(places), ["feature", "threshold"]).select("tree", "level", F.col("feature").alias("f"), "b", F.round("gain", digits).alias("gain"))


def sql_splits(trees: int, depth: int, digits: int = 3) -> str:
    return " UNION ALL ".join(f"SELECT {k - 1} AS tree, {level} AS level, CAST(f AS INTEGER) AS f, CAST(b AS INTEGER) AS b, round(gain, {digits}) AS gain FROM best{k}_{level}" for k in range(1, trees + 1) for level in range(depth))


@query(sql_boost(1, 2, "y", False) + " " + sql_splits(1, 2))
def q_tree_depth2(spark, d):
    return splits_out(spark, with_fixed_cuts(spark, d, "y", TREE))


@query(sql_boost(1, 2, "y", False) + " SELECT CAST(leaf AS INTEGER) AS leaf, round(value, 7) AS value FROM leaf1")
def q_leaf_values(spark, d):
    return with_fixed_cuts(spark, d, "y", TREE).leaves(spark).select("leaf", F.round("value", 7).alias("value"))


@query(sql_boost(1, 2, "y", False) + " SELECT CAST(leaf AS INTEGER) AS leaf, round(CASE WHEN n > 1 THEN 0.01 * greatest(sg2 / n - (sg / n) * (sg / n), 0) ELSE 0 END, 9) AS variance FROM leaf1")
def q_leaf_var(spark, d):
    return with_fixed_cuts(spark, d, "y", Params(**{**TREE.__dict__, "pgbm": True})).leaves(spark).select("leaf", F.round("variance", 9).alias("variance"))


@query(sql_boost(3, 2, "y", False) + " " + sql_splits(3, 2, 2))
def q_boost_3trees_l2(spark, d):
    return splits_out(spark, with_fixed_cuts(spark, d, "y", Params(**{**TREE.__dict__, "n_trees": 3})), 2)


@query(sql_boost(3, 2, "c", True) + f" SELECT {', '.join(KEYS)}, round(m, 6) AS score FROM t3")
def q_boost_3trees_logistic(spark, d):
    model = with_fixed_cuts(spark, d, "c", Params(**{**TREE.__dict__, "n_trees": 3, "objective": "logistic"}))
    return model.transform(table(spark, d, "lineitem")).select(*KEYS, F.round("score", 6).alias("score"))


@query(sql_boost(3, 2, "y", False) + " SELECT round(sum(CASE WHEN gain > 0 THEN gain ELSE 0 END), 2) AS gain, count(*) AS splits, (['l_quantity', 'l_discount', 'l_tax', 'l_linenumber'])[CAST(f AS INTEGER) + 1] AS feature FROM (" + sql_splits(3, 2, 9) + ") GROUP BY f ORDER BY gain DESC LIMIT 8")
def q_feature_importance_top8(spark, d):
    model = with_fixed_cuts(spark, d, "y", Params(**{**TREE.__dict__, "n_trees": 3}))
    return model.importance(spark).limit(8).select("feature", F.round("gain", 2).alias("gain"), "splits")


# --- scoring with a given forest --------------------------------------------------------------------------------------------
FOREST = {"feature": [[2, 0], [0, 1], [1, 3]], "threshold": [[0.04, 25.0], [10.0, 0.05], [0.02, 3.0]], "leaf": [[-0.3, -0.1, 0.1, 0.4], [-0.2, 0.0, 0.1, 0.3], [0.05, -0.05, 0.2, -0.2]], "variance": [[0.01, 0.02, 0.03, 0.04], [0.01, 0.01, 0.02, 0.02], [0.03, 0.02, 0.02, 0.01]]}


def forest() -> Model:
    a = {k: np.array(v) for k, v in FOREST.items()}
    return Model(FEATURES, "logistic", 0.1, a["feature"], a["threshold"], a["leaf"], np.zeros((3, 2)), a["variance"])


def sql_forest(what: str) -> str:
    terms = []
    for fs, ts, leaves in zip(FOREST["feature"], FOREST["threshold"], FOREST[what]):
        at = " + ".join(f"{2 ** (1 - i)} * (CASE WHEN {FEATURES[f]} > {t} THEN 1 ELSE 0 END)" for i, (f, t) in enumerate(zip(fs, ts)))
        terms.append(f"(CAST({leaves} AS DOUBLE[]))[1 + {at}]")
    return " + ".join(terms)


@query(f"SELECT {', '.join(KEYS)}, round(0.1 + {sql_forest('leaf')}, 9) AS score FROM lineitem")
def q_predict_forest(spark, d):
    return forest().transform(table(spark, d, "lineitem")).select(*KEYS, F.round("score", 9).alias("score"))


@query(f"WITH s AS (SELECT *, 0.1 + {sql_forest('leaf')} AS score FROM lineitem) SELECT {', '.join(KEYS)}, round(1 - 1 / (1 + exp(-score)), 9) AS p0, round(1 / (1 + exp(-score)), 9) AS p1, CASE WHEN 1 / (1 + exp(-score)) >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM s")
def q_predict_proba(spark, d):
    out = forest().predict_proba(table(spark, d, "lineitem"))
    return out.select(*KEYS, F.round(F.col("probability")[0], 9).alias("p0"), F.round(F.col("probability")[1], 9).alias("p1"), "prediction")


@query(f"WITH s AS (SELECT ({SQL_REG})::DOUBLE AS y, 0.1 + {sql_forest('leaf')} AS score, sqrt({sql_forest('variance')}) AS sigma FROM lineitem) SELECT round(avg(sigma), 9) AS mean_sigma, round(avg(CASE WHEN abs(score - y) <= 1.96 * sigma THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS coverage FROM s")
def q_predict_interval(spark, d):
    out = forest().predict_interval(table(spark, d, "lineitem").withColumn("y", reg()))
    return out.agg(F.round(F.avg("sigma"), 9).alias("mean_sigma"), F.round(metrics.coverage_of(F.col("y"), F.col("score"), F.col("sigma")), 9).alias("coverage"))


@query(f"SELECT CAST(2 * (CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) + (CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS INTEGER) AS leaf, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def q_split_apply(spark, d):
    leaf = leaf_of([F.col("l_tax"), F.col("l_quantity")], [0.04, 25.0])
    return table(spark, d, "lineitem").groupBy(leaf.alias("leaf")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


# --- target encoding --------------------------------------------------------------------------------------------------------
@query(f"WITH {SQL_ROWS} SELECT l_suppkey AS key, round((sum(y) + 10 * (SELECT avg(y) FROM nr)) / (count(*) + 10), 9) AS value FROM nr GROUP BY 1")
def q_target_encode_full(spark, d):
    df = table(spark, d, "lineitem").withColumn("y", reg())
    return encoding.TargetEncoder.fit(df, ["l_suppkey"], "y").table.select("key", F.round("value", 9).alias("value"))


@query(f"""
    WITH {SQL_ROWS}, a AS (SELECT row_id, l_suppkey, y, row_id % 5 AS fold, avg(y) OVER () AS gm FROM nr),
    w AS (SELECT *, sum(y) OVER (PARTITION BY l_suppkey) - sum(y) OVER (PARTITION BY l_suppkey, fold) AS s, count(*) OVER (PARTITION BY l_suppkey) - count(*) OVER (PARTITION BY l_suppkey, fold) AS n FROM a)
    SELECT row_id, round(CASE WHEN n > 0 THEN (s + 10 * gm) / (n + 10) ELSE gm END, 7) AS encoded FROM w""")
def q_target_encode_oof(spark, d):
    df = numbered(spark, d, ["l_suppkey", "y"])
    return encoding.TargetEncoder.out_of_fold(df, ["l_suppkey"], "y").select("row_id", F.round("l_suppkey", 7).alias("encoded"))


@query(f"""
    WITH {SQL_ROWS}, e AS (SELECT l_linenumber AS key, (sum(y) + 10 * (SELECT avg(y) FROM nr)) / (count(*) + 10) AS value FROM nr WHERE l_linenumber <= 4 GROUP BY 1)
    SELECT l_linenumber AS line, round(coalesce(any_value(e.value), (SELECT avg(y) FROM nr)), 9) AS encoded, count(*) AS n FROM nr LEFT JOIN e ON e.key = l_linenumber GROUP BY 1""")
def q_target_encode_unseen(spark, d):
    df = table(spark, d, "lineitem").withColumn("y", reg())
    mean = df.agg(F.avg("y")).first()[0]
    encoder = encoding.TargetEncoder.fit(df.where("l_linenumber <= 4"), ["l_linenumber"], "y", mean=mean)
    return encoder.transform(df.select("l_linenumber", F.col("l_linenumber").alias("line"))).groupBy("line").agg(F.round(F.first("l_linenumber"), 9).alias("encoded"), F.count("*").alias("n"))


def sql_mix(x: str) -> str:
    """mix32 of an expression from 0 to 2**32 - 1."""
    a = f"xor({x}, {x} >> 16)"
    return f"(SELECT xor(z, z >> 16) FROM (SELECT CAST((xor(y, y >> 13))::HUGEINT * {hashing.SECOND} % 4294967296 AS BIGINT) AS z FROM (SELECT CAST(({a})::HUGEINT * {hashing.FIRST} % 4294967296 AS BIGINT) AS y)))"


def sql_hash32(x: str, seed: int) -> str:
    """hash32 for numbers from 0 to 2**32 - 1."""
    return sql_mix(f"(SELECT w FROM (SELECT {sql_mix(f'xor(CAST({x} AS BIGINT), {seed & hashing.LOW})')} AS w))")


@query(f"""
    WITH {SQL_ROWS}, k AS (SELECT y, {sql_hash32('l_partkey', 0)} % 16 AS key FROM nr)
    SELECT key, round((sum(y) + 10 * (SELECT avg(y) FROM nr)) / (count(*) + 10), 9) AS value FROM k GROUP BY 1""")
def q_target_encode_hashed(spark, d):
    df = table(spark, d, "lineitem").withColumn("y", reg())
    return encoding.TargetEncoder.fit(df, ["l_partkey"], "y", buckets=16).table.select("key", F.round("value", 9).alias("value"))


@query(f"SELECT o_orderkey, {sql_hash32('o_orderkey', 7)} AS h FROM orders")
def q_row_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.hash32(F.col("o_orderkey"), 7).alias("h"))


# --- sampling ---------------------------------------------------------------------------------------------------------------
@query(f"WITH {SQL_ROWS} SELECT row_id FROM nr WHERE row_id % 3 = 7 % 3")
def q_subsample_stride(spark, d):
    return numbered(spark, d, []).where(sampling.stride_rows(F.col("row_id"), 1 / 3, 7)).select("row_id")


@query(f"WITH {SQL_ROWS} SELECT row_id FROM nr WHERE {sql_hash32('row_id', 5)} / 4294967296.0::DOUBLE < 0.3")
def q_subsample_hash(spark, d):
    return numbered(spark, d, []).where(sampling.hash_rows(F.col("row_id"), 0.3, 5)).select("row_id")


@query(f"""
    WITH {SQL_ROWS}, g AS (SELECT row_id, l_extendedprice / 100000 - 0.5 AS g, 0.5::DOUBLE AS h, {sql_hash32('row_id', 9)} / 4294967296.0::DOUBLE AS u FROM nr),
    t AS (SELECT min(a) AS t FROM (SELECT abs(g) AS a FROM g ORDER BY a DESC LIMIT (SELECT CAST(floor(0.2 * count(*)) AS BIGINT) FROM g)))
    SELECT row_id, round(g * w, 9) AS g, round(h * w, 9) AS h FROM (SELECT *, CASE WHEN abs(g) >= t THEN 1.0 WHEN u < 0.1 / 0.8 THEN 8.0 END AS w FROM g, t) WHERE w IS NOT NULL""")
def q_goss_exact(spark, d):
    df = numbered(spark, d, []).select("row_id", (F.col("l_extendedprice") / 100000 - 0.5).alias("g"), F.lit(0.5).alias("h"))
    return sampling.goss(df, 0.2, 0.1, 9).select("row_id", F.round("g", 9).alias("g"), F.round("h", 9).alias("h"))


@query(f"""
    WITH {SQL_ROWS}, g AS (SELECT row_id, l_extendedprice / 100000 - 0.5 AS g, 0.5::DOUBLE AS h, {sql_hash32('row_id', 9)} / 4294967296.0::DOUBLE AS u FROM nr),
    t AS (SELECT avg(abs(g)) / {sampling.HALF_NORMAL!r} * {inverse_normal_cdf(0.9)!r} AS t FROM g)
    SELECT row_id, round(g * w, 9) AS g, round(h * w, 9) AS h FROM (SELECT *, CASE WHEN abs(g) >= t THEN 1.0 WHEN u < 0.1 THEN 8.0 END AS w FROM g, t) WHERE w IS NOT NULL""")
def q_goss_gaussian(spark, d):
    df = numbered(spark, d, []).select("row_id", (F.col("l_extendedprice") / 100000 - 0.5).alias("g"), F.lit(0.5).alias("h"))
    return sampling.goss(df, 0.2, 0.1, 9, "gaussian").select("row_id", F.round("g", 9).alias("g"), F.round("h", 9).alias("h"))


@query(f"""
    WITH h AS (SELECT {', '.join(KEYS)}, greatest(1 / (1 + exp(-({MARGIN})::DOUBLE)) * (1 - 1 / (1 + exp(-({MARGIN})::DOUBLE))), 1e-6) AS h FROM lineitem),
    s AS (SELECT avg(h) AS mean, {inverse_normal_cdf(0.9)!r} * stddev_pop(h) AS z FROM h)
    SELECT {', '.join(KEYS)}, round(least(greatest(h, greatest(mean - z, 1e-6)), mean + z), 8) AS h FROM h, s""")
def q_hess_clamp(spark, d):
    df = table(spark, d, "lineitem").select(*KEYS, objective.hessian(F.expr(MARGIN), "logistic").alias("h"))
    return sampling.clamp_hessian(df, 0.1).select(*KEYS, F.round("h", 8).alias("h"))


# --- metrics ----------------------------------------------------------------------------------------------------------------
SCORED = f"WITH s AS (SELECT {SQL_AND} AS c, ({SQL_REG})::DOUBLE AS y, ({MARGIN})::DOUBLE AS score, l_quantity / 50 AS pred FROM lineitem) "


def scored(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(both().alias("c"), reg().alias("y"), F.expr(MARGIN).alias("score"), (F.col("l_quantity") / 50).alias("pred"))


@query(SCORED + """, r AS (SELECT c, rank() OVER (ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY round(score, 9)) - 1) / 2.0::DOUBLE AS r FROM s)
    SELECT round((sum(CASE WHEN c > 0.5 THEN r ELSE 0 END) - p * (p + 1) / 2) / (p * (n - p)), 9) AS auc FROM r, (SELECT sum(c) AS p, count(*)::DOUBLE AS n FROM s) GROUP BY p, n""")
def q_auc(spark, d):
    return metrics.auc(scored(spark, d).withColumn("score", F.round("score", 9)), "score", "c").select(F.round("auc", 9).alias("auc"))


@query(SCORED + "SELECT round(avg(-(c * ln(p) + (1 - c) * ln(1 - p))), 9) AS logloss FROM (SELECT c, least(greatest(1 / (1 + exp(-score)), 1e-7), 1 - 1e-7) AS p FROM s)")
def q_logloss(spark, d):
    return scored(spark, d).agg(F.round(metrics.logloss_of(F.col("c"), F.col("score")), 9).alias("logloss"))


@query(SCORED + "SELECT round(sqrt(avg((pred - y) * (pred - y))), 9) AS rmse FROM s")
def q_rmse(spark, d):
    return scored(spark, d).agg(F.round(metrics.rmse_of(F.col("y"), F.col("pred")), 9).alias("rmse"))


@query(SCORED + "SELECT round(avg(abs(pred - y)), 9) AS mae FROM s")
def q_mae(spark, d):
    return scored(spark, d).agg(F.round(metrics.mae_of(F.col("y"), F.col("pred")), 9).alias("mae"))


@query(SCORED + "SELECT round(1 - sum((pred - y) * (pred - y)) / (var_pop(y) * count(*)), 9) AS r2 FROM s")
def q_r2(spark, d):
    return scored(spark, d).agg(F.round(metrics.r2_of(F.col("y"), F.col("pred")), 9).alias("r2"))


@query(SCORED + "SELECT round(avg(CASE WHEN (round(score, 9) > 0) = (c > 0.5) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy FROM s")
def q_accuracy(spark, d):
    return scored(spark, d).agg(F.round(metrics.accuracy_of(F.col("c"), F.round("score", 9)), 9).alias("accuracy"))


# --- preparation ------------------------------------------------------------------------------------------------------------
@query("""
    WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS x FROM part)
    SELECT p_partkey, round(coalesce(x, (SELECT median(x) FROM m)), 6) AS price FROM m""")
def q_impute_median(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("x"))
    return preprocess.impute_median(df, ["x"]).select("p_partkey", F.round("x", 6).alias("price"))


@query("""
    WITH c AS (SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_brand END, '__NA__') AS c FROM part)
    SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS code FROM c""")
def q_ordinal_codes(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("brand"))
    return preprocess.ordinal_codes(df, "brand", "code").select("p_partkey", "code")


@query(f"WITH {SQL_ROWS} SELECT {', '.join(KEYS)}, row_id FROM nr")
def q_row_id(spark, d):
    return numbered(spark, d, []).select(*KEYS, "row_id")


# --- training, persistence, streams -------------------------------------------------------------------------------------------
@query()
def q_train_l2(spark, d):
    """A depth-4 forest on the derived target: tree, level, feature, threshold, gain."""
    df = table(spark, d, "lineitem").withColumn("y", reg())
    return Trainer(Params(n_trees=3, depth=4, n_bins=64, objective="l2"), FEATURES, "y", order_by=KEYS).fit(df).splits(spark)


@query()
def q_train_categorical(spark, d):
    """A classifier with target-encoded brands and distinct-value bins, scored on the table."""
    df = table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("double").alias("brand"), F.col("p_size").cast("double").alias("size"), F.when(F.col("p_retailprice") > 1400, 1.0).otherwise(0.0).alias("y"))
    params = Params(n_trees=2, depth=3, n_bins=32, unique_bins=True, categorical=("brand",))
    return Trainer(params, ["brand", "size"], "y", order_by=["p_partkey"]).fit(df).transform(df).select("p_partkey", "score")


@query(f"SELECT {', '.join(KEYS)}, round(0.1 + {sql_forest('leaf')}, 9) AS score FROM lineitem")
def q_stream_score(spark, d):
    """lineitem read as a stream and scored by the given forest into files, which are read back."""
    import uuid

    from terrace.storage import shared_dir
    from terrace.streaming.scoring import score_stream

    schema = table(spark, d, "lineitem").schema
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem*.parquet").parquet(d)
    score_stream(forest(), stream.select(*dict.fromkeys([*KEYS, *FEATURES])), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select(*KEYS, F.round("score", 9).alias("score"))


@query(f"SELECT {', '.join(KEYS)}, round(0.1 + {sql_forest('leaf')}, 9) AS score FROM lineitem")
def q_model_round_trip(spark, d):
    """A model saved, loaded and used."""
    import uuid

    from terrace.storage import shared_dir

    at = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    forest().save(spark, at)
    return Model.load(spark, at).transform(table(spark, d, "lineitem")).select(*KEYS, F.round("score", 9).alias("score"))

