"""Training against an independent derivation, and properties of forests."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace import Classifier, Params, Regressor, load
from terrace.functions import hashing, metrics
from terrace.operators import binning, histogram, preprocess, sampling, split
from terrace.operators.encoding import TargetEncoder
from terrace.plans.model import Model
from terrace.plans.trainer import Trainer
from terrace.sources import blobs, synthetic
from terrace.storage import with_row_id


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4)).round(2)
    y = np.where(x[:, 0] > 0.2, 1.0, 0.0) * 0.5 + 0.3 * (x[:, 1] > -0.5) + 0.1 * (x[:, 2] > 0) * (x[:, 0] > 0) + rng.normal(0, 0.01, 600)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "row_id long, f0 double, f1 double, f2 double, f3 double, y double").repartition(3).persist()


NAMES = ["f0", "f1", "f2", "f3"]


def reference(x, y, p: Params):
    """Boosting written once more, row by row and from the definitions."""
    n, nf = x.shape
    cuts = np.array([[np.sort(x[:, f])[int((j + 1) / p.n_bins * (n - 1) + 0.5)] for j in range(p.n_bins - 1)] for f in range(nf)])
    bins = np.array([[sum(c < v for c in cuts[f]) for f, v in enumerate(r)] for r in x])
    m = min(max(y.mean(), 1e-6), 1 - 1e-6)
    logistic = p.objective == "logistic"
    margin = np.full(n, math.log(m / (1 - m)) if logistic else m)
    trees = []
    for _ in range(p.n_trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = (prob - y, np.maximum(prob * (1 - prob), 1e-6)) if logistic else (margin - y, np.ones(n))
        node, splits = np.zeros(n, int), []
        for level in range(p.depth):
            best = None
            for f in range(nf):
                for b in range(p.n_bins - 1):
                    gain = 0.0
                    for k in range(1 << level):
                        own = node == k
                        right = own & (bins[:, f] > b)
                        gr, hr, gt, ht = g[right].sum(), h[right].sum(), g[own].sum(), h[own].sum()
                        if ht - hr >= p.min_child and hr >= p.min_child:
                            gain += (gt - gr) ** 2 / (ht - hr + p.l2) + gr**2 / (hr + p.l2) - gt**2 / (ht + p.l2)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, b)
            splits.append(best)
            node = node * 2 + (bins[:, best[1]] > best[2])
        leaf = np.array([-p.learning_rate * g[node == k].sum() / (h[node == k].sum() + p.l2) if (node == k).any() else 0.0 for k in range(1 << p.depth)])
        margin = margin + leaf[node]
        trees.append((splits, leaf, cuts))
    return trees, margin


@pytest.mark.parametrize("objective", ["l2", "logistic"])
@pytest.mark.parametrize("subtract", [True, False])
def test_against_an_independent_derivation(data, objective, subtract):
    x, y, df = data
    if objective == "logistic":
        y = (y > 0.5).astype(float)
        df = df.withColumn("y", F.when(F.col("y") > 0.5, 1.0).otherwise(0.0))
    p = Params(n_trees=3, depth=3, n_bins=8, objective=objective, subtract=subtract)
    model = Trainer(p, NAMES, "y", "row_id").fit(df)
    trees, margin = reference(x, y, p)
    for t, (splits, leaf, cuts) in enumerate(trees):
        assert model.feature[t].tolist() == [f for _, f, _ in splits]
        assert model.threshold[t].tolist() == [cuts[f, b] for _, f, b in splits]
        assert np.allclose(model.leaf[t], leaf)
        assert np.allclose(model.gain[t], [g for g, _, _ in splits])
    got = np.array([r.score for r in model.transform(df).orderBy("row_id").collect()])
    assert np.allclose(got, margin)


def test_driver_and_query_search_agree(data, monkeypatch):
    _, _, df = data
    from terrace.plans import trainer

    p = Params(n_trees=2, depth=3, n_bins=16, objective="l2", monotone={"f0": 1, "f1": -1}, min_child=20)
    a = Trainer(p, NAMES, "y", "row_id").fit(df)
    monkeypatch.setattr(trainer, "DRIVER_CELLS", 0)
    b = Trainer(p, NAMES, "y", "row_id").fit(df)
    assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and np.allclose(a.leaf, b.leaf)


def test_more_trees_fit_better_and_checkpoints_change_nothing(data):
    _, _, df = data
    errors = []
    for n in (1, 6, 13):
        r = Regressor(NAMES, row_id="row_id", n_trees=n, depth=3, n_bins=32).fit(df)
        errors.append(r.evaluate(df)["rmse"])
    assert errors[0] > errors[1] > errors[2]
    few = Regressor(NAMES, row_id="row_id", n_trees=6, depth=3, n_bins=32).fit(df).model
    assert np.allclose(few.leaf, r.model.leaf[:6])


def test_scoring_by_projection_and_by_batches_agree_and_missing_goes_left(spark, data):
    _, _, df = data
    model = Regressor(NAMES, row_id="row_id", n_trees=7, depth=4, n_bins=32).fit(df).model
    odd = spark.createDataFrame([(float("nan"), None, 1e308, -1.0), (None, None, None, None), (0.5, float("nan"), float("-inf"), float("inf"))], "f0 double, f1 double, f2 double, f3 double")
    rows = df.select(*NAMES).union(odd)
    a = rows.withColumn("score", model.margin()).collect()
    b = model.transform(rows).collect()
    assert np.allclose(sorted(r.score for r in a), sorted(r.score for r in b))
    left = model.base + sum(leaf[0] for leaf in model.leaf)
    assert np.isclose(model.transform(odd).where("f0 is null").first().score, left)
    assert model.transform(rows.limit(0)).count() == 0 and model.transform(rows.limit(1)).count() == 1
    with pytest.raises(ValueError, match="missing"):
        model.transform(rows.drop("f2"))


@pytest.mark.parametrize("options", [
    {"subsample": 0.4}, {"subsample": 0.4, "sampling": "hash"}, {"goss_top": 0.2, "goss_other": 0.2}, {"goss_top": 0.2, "goss_mode": "gaussian"}, {"goss_top": 0.3, "strict_goss": True},
    {"colsample": 0.5}, {"clamp_hessian": 0.05}, {"int_hist": True}, {"unique_bins": True}, {"pgbm": True}, {"feasibility": "any", "min_child": 20},
])
def test_options_train_and_learn(data, options):
    _, _, df = data
    y = df.withColumn("y", F.when(F.col("y") > 0.5, 1.0).otherwise(0.0))
    c = Classifier(NAMES, row_id="row_id", n_trees=6, depth=3, n_bins=32, learning_rate=0.3, **options).fit(y)
    assert c.evaluate(y)["auc"] > 0.9
    assert (c.model.variance.sum() > 0) == bool(options.get("pgbm"))


def test_monotone_and_colsample_hold(data):
    x, _, df = data
    r = Regressor(NAMES, row_id="row_id", n_trees=4, depth=2, n_bins=32, monotone={"f0": -1}).fit(df)
    assert not (r.model.feature == 0).any() or (r.model.gain[r.model.feature == 0] <= 0).all()
    p = Params(n_trees=5, depth=2, colsample=0.4, objective="l2", n_bins=16)
    model = Trainer(p, NAMES, "y", "row_id").fit(df)
    for t in range(5):
        assert set(model.feature[t]) <= set(sampling.kept_features(4, 0.4, sampling.tree_seed(0, t)))


def test_intervals_importance_and_proba(spark, data):
    _, _, df = data
    r = Regressor(NAMES, row_id="row_id", n_trees=5, depth=3, n_bins=32, pgbm=True).fit(df)
    out = r.predict_interval(df).collect()
    assert all(x.low <= x.score <= x.high and x.sigma >= 0 for x in out)
    top = r.feature_importance(spark).collect()
    assert top[0].feature == "f0" and sum(x.splits for x in top) == 15
    c = Classifier(NAMES, row_id="row_id", n_trees=2, depth=2).fit(df.withColumn("y", F.when(F.col("y") > 0.5, 1.0).otherwise(0.0)))
    for x in c.predict_proba(df).limit(20).collect():
        assert math.isclose(sum(x.probability), 1) and x.prediction == (x.probability[1] >= 0.5)


def test_categories(spark):
    rows = [(i, float(i % 7), float(i % 3), 1.0 if i % 7 in (1, 4) else 0.0) for i in range(350)]
    df = spark.createDataFrame(rows, "row_id long, c double, x double, y double")
    c = Classifier(["c", "x"], row_id="row_id", categorical=["c"], n_trees=5, depth=2).fit(df)
    assert c.params.unique_bins and c.evaluate(df)["auc"] == 1.0
    new = c.transform(spark.createDataFrame([(99.0, 1.0), (1.0, 1.0)], "c double, x double")).collect()
    assert len(new) == 2 and new[0].score != new[1].score and new[0].asDict().keys() >= {"x", "score"}
    hashed = Classifier(["c", "x"], row_id="row_id", categorical=["c"], cat_hash_buckets=64, n_trees=3, depth=2).fit(df)
    assert hashed.evaluate(df)["auc"] > 0.7


def test_out_of_fold_encoding_by_hand(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 0.0), (2, 2.0, 1.0), (5, 1.0, 1.0), (3, 2.4, 0.0), (4, 9.0, 1.0)], "row_id long, c double, y double")
    mean = 4 / 6
    got = {r.row_id: r.c for r in TargetEncoder.out_of_fold(df, ["c"], "y", 5, 10).collect()}
    assert math.isclose(got[0], (0 + 10 * mean) / 11) and math.isclose(got[1], (2 + 10 * mean) / 12) and math.isclose(got[4], mean)
    assert math.isclose(got[2], (0 + 10 * mean) / 11) and math.isclose(got[3], (1 + 10 * mean) / 11)


def test_save_and_load(spark, data, tmp_path):
    _, _, df = data
    y = df.withColumn("c", (F.col("row_id") % 5).cast("double"))
    r = Regressor([*NAMES, "c"], row_id="row_id", categorical=["c"], n_trees=6, depth=3, n_bins=16, pgbm=True).fit(y)
    r.save(spark, f"{tmp_path}/m")
    back = load(spark, f"{tmp_path}/m")
    key = lambda m: sorted((x.row_id, x.score) for x in m.transform(y).collect())
    assert isinstance(back, Regressor) and key(back) == key(r) and (back.model.variance == r.model.variance).all() and back.params == r.params
    raw = blobs.model_bytes(r.model)
    taken = blobs.model_of_bytes(spark, raw, r.features)
    assert blobs.model_bytes(taken) == raw
    a, b = key(r), key(taken)
    assert np.allclose([s for _, s in a], [s for _, s in b], atol=1e-5)
    with pytest.raises(ValueError, match="not a model"):
        blobs.model_of_bytes(spark, b"XXXX" + raw[4:])


def test_dataset_blobs_and_command_line(spark, data, tmp_path):
    import json

    from terrace import cli

    x, y, _ = data
    for name, a in (("x_train", x), ("y_train", y > 0.5), ("x_test", x[:50]), ("y_test", y[:50] > 0.5)):
        a.astype("<f4").tofile(f"{tmp_path}/{name}.bin")
    (tmp_path / "meta.json").write_text(json.dumps({"n_train": 600, "n_test": 50, "n_features": 4}))
    df = blobs.read_dataset(spark, str(tmp_path))
    assert df.columns == ["row_id", *NAMES, "y", "split"] and df.where("split = 'train'").count() == 600
    first = df.where("split = 'test' and row_id = 3").first()
    assert np.allclose([first[c] for c in NAMES], x[3], atol=1e-6)
    said: list[str] = []
    flags = f"--data {tmp_path} --trees 6 --depth 2 --bins 16 --device cpu --pack4 1 --save-model {tmp_path}/m --dump-pred {tmp_path}/p.bin --profile-out {tmp_path}/prof.json".split()
    out = cli.run(spark, flags, said.append)
    assert out["auc"] > 0.9 and said[0].startswith("RESULT objective=logistic train_s=") and np.fromfile(f"{tmp_path}/p.bin", "<f4").size == 50
    assert json.loads((tmp_path / "prof.json").read_text())["total_ns"] > 0
    again: list[str] = []
    cli.serve(spark, [f"--data\t{tmp_path}\t--load-model\t{tmp_path}/m\n", "--what 1\n", "--data\n", "QUIT\n", "never\n"], again.append)
    assert again[0].startswith("OK RESULT") and again[1] == cli.END and again[2].startswith("ERROR") and again[4].startswith("ERROR") and len(again) == 6
    (tmp_path / "meta.json").write_text(json.dumps({"n_train": 599, "n_test": 50, "n_features": 4}))
    with pytest.raises(ValueError, match="meta.json"):
        blobs.read_dataset(spark, str(tmp_path))


def test_parameters():
    p, rest = Params.from_flags("--trees 7 --objective rmse --subtract 0 --unique-bins true --pgbm yes --categorical a,b --monotone f0:1,f1:-1 --data d".split())
    assert (p.n_trees, p.objective, p.subtract, p.unique_bins, p.pgbm, p.categorical, p.monotone, rest) == (7, "l2", False, True, False, ("a", "b"), {"f0": 1, "f1": -1}, {"data": "d"})
    for bad in ("--bins 1", "--bins 257", "--depth 0", "--depth 13", "--objective poisson", "--trees", "trees 3", "--device tpu"):
        with pytest.raises(ValueError):
            Params.from_flags(bad.split())
    assert Params().objective == "logistic" and Params().n_bins == 256 and Params().bin_sample == 200_000
    with pytest.raises(TypeError):
        Regressor(["x"], trees=3)


def test_refusals(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, 2.0, 1.0)], "row_id long, x double, y double")
    with pytest.raises(ValueError, match="label"):
        Regressor(["x"], row_id="row_id").fit(df)
    with pytest.raises(ValueError, match="no rows"):
        Regressor(["x"], row_id="row_id").fit(df.limit(0))
    with pytest.raises(ValueError, match="features"):
        Regressor(["x"], categorical=["z"]).fit(df)
    with pytest.raises(ValueError):
        Regressor(["x"]).transform(df)


@pytest.mark.parametrize("n_bins", [2, 5, 256])
def test_bins_by_both_ways(spark, n_bins, monkeypatch):
    rng = np.random.default_rng(n_bins)
    v = [*rng.choice([0.5, 1.0, 2.0, 3.5], 100).tolist(), float("nan"), None, float("inf"), float("-inf")]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    cuts = np.sort(rng.choice([0.5, 1.0, 1.5, 2.0, np.inf], (1, n_bins - 1)))
    want = sorted((str(x), 0 if x is None or x != x else int(sum(c < x for c in cuts[0] if c != np.inf))) for x in v)
    for most in (10**6, 0):
        monkeypatch.setattr(binning, "COMPILED", most)
        got = sorted((str(r.x), r.b0) for r in binning.assign_bins(df, ["x"], cuts).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(g[1] == w[1] or g[0] == "inf" for g, w in zip(got, want))


def test_subtracted_histograms_equal_built_ones(data):
    _, _, df = data
    rows = df.select(*(F.floor(F.col(c) * 2).cast("int").alias(f"b{i}") for i, c in enumerate(NAMES)), F.when(F.col("f0") > 0, 1).otherwise(0).alias("node"), F.col("y").alias("g"), F.lit(1.0).alias("h"))
    names = [f"b{i}" for i in range(4)]
    direct = {(r.node, r.f, r.b): (r.g, r.n) for r in histogram.build(rows, names).collect()}
    by = histogram.subtract(histogram.build(rows.withColumn("node", F.lit(0)), names), histogram.build(rows.where("node = 1"), names))
    got = {(r.node, r.f, r.b): (r.g, r.n) for r in by.collect()}
    assert got.keys() == direct.keys() and all(math.isclose(got[k][0], direct[k][0], abs_tol=1e-9) and got[k][1] == direct[k][1] for k in got)


def test_split_search_in_arrays_and_queries(spark):
    rng = np.random.default_rng(5)
    g, h = rng.normal(size=(4, 3, 8)), rng.integers(0, 4, (4, 3, 8)).astype(float)
    g[h == 0] = 0
    cells = spark.createDataFrame([(n, f, b, float(g[n, f, b]), float(h[n, f, b])) for n in range(4) for f in range(3) for b in range(8) if h[n, f, b]], "node int, f int, b int, g double, h double")
    sums = split.prefix(histogram.dense(cells, 4, 3, 8))
    for feasibility in ("each", "any"):
        for monotone in ({}, {0: 1, 2: -1}):
            for l2 in (0.0, 1.0):
                r = split.best(split.gains(sums, 8, l2, 2.0, feasibility, monotone)).first()
                want = split.best_of_arrays(g, h, l2, 2.0, feasibility, np.array([monotone.get(i, 0) for i in range(3)]))
                assert (r.f, r.b) == want[:2] and math.isclose(r.gain, want[2], rel_tol=1e-9)


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    for v in (rng.exponential(size=9000), np.repeat([0.0, 1.0, 5.0], 3000), np.zeros(10), rng.choice([1e-300, 1e300], 50)):
        df = spark.createDataFrame([(float(x),) for x in v], "x double")
        for k in (1, 2, len(v) // 3, len(v)):
            assert sampling.kth_largest(df, "x", k) == sorted(v.tolist(), reverse=True)[k - 1]


def test_hashes(spark):
    rows = [(i,) for i in (0, 1, 2**31, 2**32 - 1, 2**32, -1, 10**18, *range(100))]
    got = spark.createDataFrame(rows, "x long").select("x", hashing.hash32(F.col("x"), 12345).alias("h")).collect()
    assert all(r.h == hashing.hash32_of(r.x, 12345) for r in got)
    u = [r[0] for r in spark.range(20_000).select(hashing.hash01(F.col("id"), 3)).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.01
    keys = spark.createDataFrame([(2.5,), (-2.5,), (0.4,), (None,), (float("nan"),)], "v double").select(hashing.category_key(F.col("v"))).collect()
    assert [k[0] for k in keys] == [3, -3, 0, 0, 0]


def test_metrics(spark):
    rows = [(0.1, 0.0), (0.4, 1.0), (0.4, 0.0), (0.8, 1.0), (-1.0, 0.0)]
    df = spark.createDataFrame(rows, "score double, y double")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(metrics.auc(df).first().auc, want)
    assert math.isnan(metrics.auc(df.where("y = 0")).first().auc)
    assert math.isnan(df.where("y = 0").agg(metrics.r2_of(F.col("y"), F.col("score"))).first()[0])
    many = synthetic.uniform_rows(spark, 3000, 2, 5, 0, 1).select(F.round("f0", 2).alias("score"), F.when(F.col("f1") < F.col("f0"), 1.0).otherwise(0.0).alias("y"))
    r = many.collect()
    s, y = np.array([x.score for x in r]), np.array([x.y for x in r])
    rank = np.array([(s < v).sum() + ((s == v).sum() + 1) / 2 for v in s])
    p = y.sum()
    assert math.isclose(metrics.auc(many).first().auc, (rank[y > 0].sum() - p * (p + 1) / 2) / (p * (len(y) - p)))


def test_preparation(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, None), (float("nan"), "b")], "x double, c string")
    assert sorted(r.x for r in preprocess.impute_median(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    assert preprocess.impute_median(df.where("x is null"), ["x"]).first().x == 0.0
    codes = {r.c: r.k for r in preprocess.ordinal_codes(df, "c", "k").collect()}
    assert codes == {None: 0, "a": 1, "b": 2}


def test_row_ids(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "k long, v string").repartition(5)
    got = with_row_id(df, ["k"]).collect()
    assert all(r.row_id == r.k for r in got)
    assert sorted(r.row_id for r in with_row_id(df).collect()) == list(range(1000)) and with_row_id(df.limit(0), ["k"]).count() == 0


def test_synthetic_sources(spark):
    a, b = synthetic.regression(spark, 500, seed=1), synthetic.regression(spark, 500, seed=1)
    assert len(a.columns) == 27 and a.exceptAll(b).count() == 0
    c = synthetic.classification(spark, 500, 6, 4)
    assert {r.y for r in c.select("y").distinct().collect()} == {0.0, 1.0}
    fitted = Classifier([f"f{i}" for i in range(6)], row_id="row_id", n_trees=8, depth=3, n_bins=16, learning_rate=0.3).fit(c)
    assert fitted.evaluate(c)["auc"] > 0.75
    low, high = synthetic.uniform_rows(spark, 1000, 1).agg(F.min("f0"), F.max("f0")).first()
    assert -4 <= low < -3.5 and 3.5 < high < 4


def test_unique_and_quantile_cuts(spark):
    df = spark.createDataFrame([(float(i % 9), 5.0, None) for i in range(90)], "a double, b double, c double")
    got = binning.collect_cuts(binning.unique_cuts(df, ["a", "b", "c"], 16), 3, 16)
    assert got[0][:8].tolist() == [i + 0.5 for i in range(8)] and np.isinf(got[0][8:]).all() and np.isinf(got[1:]).all()
    few = binning.collect_cuts(binning.unique_cuts(df, ["a"], 4), 1, 4)
    assert few[0].tolist() == [(8 * (j + 1) // 4) + 0.5 for j in range(3)]
    q = binning.collect_cuts(binning.quantile_cuts(df, ["a", "b", "c"], 4), 3, 4)
    assert q[0].tolist() == [2.0, 4.0, 6.0] and q[1].tolist() == [5.0] * 3 and np.isinf(q[2]).all()


def test_model_is_plain_data():
    assert Model.__dataclass_fields__.keys() >= {"feature", "threshold", "leaf", "gain", "variance", "base"}
