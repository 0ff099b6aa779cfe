"""The boosting loop: one aggregation job for each level of each tree."""

from __future__ import annotations

import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators import binning, histogram, sampling, split
from terrace.operators.encoding import TargetEncoder
from terrace.operators.objective import LEAST_HESSIAN, base_score, gradient, hessian
from terrace.params import Params
from terrace.plans.model import Model
from terrace.storage import staged, unstage, with_row_id

DRIVER_CELLS = 1_000_000
"""Histogram cells (node, feature, bin) up to which a level's sums are searched on the driver; beyond, by the same search as a query."""
COUNTED = 1 << 17
"""Rows that a task counts at once."""
TREES_A_TABLE = 5
"""Trees whose margins are added by one projection before the margins are written again: lineage and expressions stay short."""


def node_of(splits: list[tuple[int, int]]) -> Column:
    """A row's node after the splits (feature, bin) of the levels so far, from its bins."""
    out = F.lit(0)
    for f, b in splits:
        out = out * 2 + F.when(F.col(f"b{f}") > b, 1).otherwise(0)
    return out


class Trainer:
    def __init__(self, params: Params, features: list[str], label: str, row_id: str | None = None, order_by: list[str] | None = None):
        self.p, self.features, self.label, self.row_id, self.order_by = params, list(features), label, row_id, order_by
        self.profile: dict[str, float] = defaultdict(float)
        unknown = set(params.categorical) - set(features) | set(params.monotone) - set(features)
        if unknown:
            raise ValueError(f"not among the features: {sorted(unknown)}")

    def _timed(self, what: str, since: float) -> float:
        now = time.perf_counter()
        self.profile[what] += now - since
        return now

    def fit(self, df: DataFrame) -> Model:
        """Rows with a null label are refused; features may be null or NaN (bin 0)."""
        p, t = self.p, time.perf_counter()
        rows = df.select(*(F.col(c).cast("double").alias(c) for c in self.features), F.col(self.label).cast("double").alias("_y"), *([F.col(self.row_id).alias("_row")] if self.row_id else []), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(self.order_by or [])))
        n, mean, nulls = rows.agg(F.count("*"), F.avg("_y"), F.count_if(F.col("_y").isNull())).first()
        if not n or nulls:
            raise ValueError("no rows to train on" if not n else f"{nulls} rows have no label")
        if not self.row_id:  # positions cost a sort: only where something is chosen by them
            placed = p.categorical or p.goss_top or p.subsample < 0.999 or n // max(p.bin_sample, 1) > 1
            rows = with_row_id(rows, [f"_k{i}" for i in range(len(self.order_by or []))] or None, "_row") if placed else rows.withColumn("_row", F.lit(None).cast("long"))
        t = self._timed("load", t)
        encoder = None
        if p.categorical:
            encoder = TargetEncoder.fit(rows, list(p.categorical), "_y", p.te_smoothing, p.cat_hash_buckets, mean)
            encoder.table = staged(encoder.table, "encoder")
            rows = TargetEncoder.out_of_fold(rows, list(p.categorical), "_y", p.te_folds, p.te_smoothing, p.cat_hash_buckets, mean, "_row")
        sample = binning.strided_sample(rows, p.bin_sample, n, "_row")
        cuts = binning.collect_cuts((binning.unique_cuts if p.unique_bins or p.categorical else binning.quantile_cuts)(sample, self.features, p.n_bins), len(self.features), p.n_bins)
        t = self._timed("cuts", t)
        base = base_score(mean, p.objective, p.clamp_base)
        frame = staged(binning.assign_bins(rows, self.features, cuts, ["_row", "_y"]).withColumn("m", F.lit(base)), "frame")
        self._timed("bins", t)

        feature, threshold, gain, leaf, variance = [], [], [], [], []
        current, done = frame.persist(), None
        pending: list[tuple[list, np.ndarray]] = []
        for tree in range(p.n_trees):
            splits, gains, values, spread = self._tree(current, pending, tree, n)
            feature.append([f for f, _ in splits])
            threshold.append([cuts[f, b] for f, b in splits])
            gain.append(gains)
            leaf.append(values)
            variance.append(spread)
            pending.append((splits, values))
            if len(pending) == TREES_A_TABLE and tree + 1 < p.n_trees:
                t = time.perf_counter()
                new = staged(self._margins(current, pending), "frame")
                current.unpersist()
                if done is not None:
                    unstage(done)
                done, current, pending = new, new.persist(), []
                self._timed("margins", t)
        current.unpersist()
        for x in (frame, done):
            if x is not None:
                unstage(x)
        return Model(self.features, p.objective, base, np.array(feature), np.array(threshold), np.array(leaf), np.array(gain), np.array(variance), encoder, p, dict(self.profile))

    @staticmethod
    def _margins(df: DataFrame, trees: list[tuple[list, np.ndarray]]) -> DataFrame:
        m = F.col("m")
        for splits, values in trees:
            m = m + F.element_at(F.array(*map(F.lit, values.tolist())), node_of(splits) + 1)
        return df.withColumn("m", m) if trees else df

    def _tree(self, current: DataFrame, pending: list[tuple[list, np.ndarray]], tree: int, n: int) -> tuple[list[tuple[int, int]], list[float], np.ndarray, np.ndarray]:
        p, seed = self.p, sampling.tree_seed(self.p.seed, tree)
        nf = len(self.features)
        y, m = F.col("_y"), F.col("m")
        rows = self._margins(current, pending)
        every = not p.goss_top and not p.clamp_hessian and p.subsample >= 0.999  # all rows count, with the gradients of their margins
        if p.goss_top == 0 and p.subsample < 0.999:
            row = F.col("_row")
            rows = rows.where(sampling.stride_rows(row, p.subsample, tree) if p.sampling == "stride" else sampling.hash_rows(row, p.subsample, seed))
        rows = rows.withColumn("g", gradient(y, m, p.objective)).withColumn("h", hessian(m, p.objective))
        if p.clamp_hessian:
            rows = sampling.clamp_hessian(rows, p.clamp_hessian)
        if p.goss_top:
            rows = sampling.goss(rows, p.goss_top, p.goss_other, seed, p.goss_mode, p.strict_goss, row_id="_row", n=n)
        kept = sampling.kept_features(nf, p.colsample, seed) if p.colsample < 1 else list(range(nf))
        allowed = np.isin(np.arange(nf), kept)
        monotone = np.array([p.monotone.get(c, 0) for c in self.features])
        squares = p.pgbm
        if squares:
            rows = rows.withColumn("g2", F.col("g") * F.col("g"))

        splits: list[tuple[int, int]] = []
        gains: list[float] = []
        parent: np.ndarray | None = None
        for level in range(p.depth):
            t = time.perf_counter()
            nodes = 1 << level
            at = rows.withColumn("node", node_of(splits))
            small = nodes * nf * p.n_bins <= DRIVER_CELLS
            if small:
                odd = p.subtract and level > 0
                if every:
                    found = self._sums(current, kept, nodes, squares, list(splits), list(pending), odd)
                else:
                    found = self._sums(at.where(F.col("node") % 2 == 1) if odd else at, kept, nodes, squares)
                if odd:  # an even child is its parent less its sibling
                    found[:, 0::2] = parent - found[:, 1::2]
                parent = found
                t = self._timed("histogram", t)
                f, b, gain = split.best_of_arrays(found[0], found[1], p.l2, p.min_child, p.feasibility, monotone, allowed)
            else:
                parent = None
                hist = histogram.build(at, [f"b{i}" for i in kept], kept, scale=p.int_scale if p.int_hist else None)
                sums = split.prefix(histogram.dense(hist, nodes, nf, p.n_bins)).where(F.col("f").isin(kept))
                f, b, gain = split.best(split.gains(sums, p.n_bins, p.l2, p.min_child, p.feasibility, {i: int(s) for i, s in enumerate(monotone) if s})).first()
            splits.append((f, b))
            gains.append(gain)
            self._timed("split", t)
        t = time.perf_counter()
        if parent is not None:  # the last level's sums hold those of the leaves, on both sides of its split
            side = parent[:, :, splits[-1][0]]
            left = side[:, :, : splits[-1][1] + 1].sum(2)
            leaves = np.stack([left, side.sum(2) - left], 2).reshape(len(parent), -1)
        else:
            by = rows.groupBy(node_of(splits).alias("leaf")).agg(F.sum("g"), F.sum("h"), F.count("*"), F.sum("g2" if squares else F.lit(0.0))).collect()
            leaves = np.zeros((4, 1 << p.depth))
            for r in by:
                leaves[:, r[0]] = r[1:]
        g, h, count, g2 = leaves
        total = h + p.l2
        has = (count > 0.5) & (total != 0)
        values = np.where(has, -p.learning_rate * g / np.where(has, total, 1), 0.0)
        rows_in = np.maximum(count, 1)
        spread = np.where(count > 1.5, p.learning_rate**2 * np.maximum(g2 / rows_in - (g / rows_in) ** 2, 0), 0.0)
        self._timed("leaves", t)
        return splits, gains, values, spread

    def _sums(self, rows: DataFrame, kept: list[int], nodes: int, squares: bool, splits: list[tuple[int, int]] | None = None, pending: list | None = None, odd: bool = False) -> np.ndarray:
        """g, h, count and squares by [what, node, feature, bin], collected: a bounded number of cells.

        Each task sums its own rows into an array, so the shuffle carries its non-empty cells, and no row is copied for each feature. rows has node, g and h; or, with `splits`,
        labels and written margins, from which the task works these out: then the plan is the same for every level and tree, and Spark compiles it once.
        """
        p = self.p
        what = ["g", "h", *(["g2"] if squares else [])]
        nf, n_bins = len(self.features), p.n_bins
        scale = p.int_scale if p.int_hist else None
        objective = p.objective
        ready = splits is None
        bins = kept if ready else list(range(len(self.features)))
        columns = ["node", *what, *(f"b{f}" for f in bins)] if ready else ["_y", "m", *(f"b{f}" for f in bins)]

        def place(b: dict[int, np.ndarray], path: list[tuple[int, int]], n: int) -> np.ndarray:
            node = np.zeros(n, np.int64)
            for f, cut in path:
                node = node * 2 + (b[f] > cut)
            return node

        def prepared(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray], dict[int, np.ndarray]]:
            cols = [c.to_numpy() for c in batch.columns]
            head = 1 + len(what) if ready else 2
            b = dict(zip(bins, cols[head:]))
            if ready:
                return cols[0].astype(np.int64), cols[1:head], b
            y, m = cols[0], cols[1].copy()
            for path, values in pending:
                m += values[place(b, path, len(m))]
            if objective == "logistic":
                prob = 1 / (1 + np.exp(-m))
                g, h = prob - y, np.maximum(prob * (1 - prob), LEAST_HESSIAN)
            else:
                g, h = m - y, np.ones(len(m))
            node = place(b, splits, len(m))
            if odd:
                on = node % 2 == 1
                node, g, h, b = node[on], g[on], h[on], {f: b[f][on] for f in kept}
            return node, [g, h, *([g * g] if squares else [])], b

        def count(batches):
            sums, held, size = np.zeros((len(what) + 1, nodes, nf, n_bins)), [], 0
            for batch in batches:
                held.append(prepared(batch))
                size += batch.num_rows
                if size >= COUNTED:
                    add(sums, held)
                    held, size = [], 0
            if held:
                add(sums, held)
            sums = sums.reshape(len(sums), -1)
            cell = np.flatnonzero(sums[-1])
            if len(cell):
                yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(x[cell]) for x in sums)], names=["cell", *what, "n"])

        def add(sums: np.ndarray, held: list) -> None:
            """Each feature counts into its own nodes * n_bins cells."""
            start = np.concatenate([x[0] for x in held]) * n_bins
            weights = [np.concatenate(w) for w in zip(*(x[1] for x in held))]
            if scale:
                weights = [np.trunc(w * scale + np.copysign(0.5, w)) for w in weights[:2]] + weights[2:]
            for f in kept:
                at = start + np.concatenate([x[2][f] for x in held])
                for k, w in enumerate([*weights, None]):
                    sums[k, :, f] += np.bincount(at, w, nodes * n_bins).reshape(nodes, n_bins)

        kinds = "cell long, " + ", ".join(f"{c} double" for c in [*what, "n"])
        parts = rows.select(*columns).mapInArrow(count, kinds)
        table = parts.groupBy("cell").agg(*(F.sum(c).alias(c) for c in [*what, "n"])).toArrow()
        cell = table["cell"].to_numpy()
        out = np.zeros((4, nodes * nf * n_bins))
        for i, c in enumerate(("g", "h", "n", "g2")[: 3 + squares]):
            out[i][cell] = table[c].to_numpy()
        if scale:
            out[:2] /= scale
        return out.reshape(4, nodes, nf, n_bins)
