import math

import numpy as np
import pytest

from terrace.llm import topk


def brute(rows, asked, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {i: min(v for j, v in ok if j == i) for i, _ in ok if i in asked}.items():
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def vectors(n, width=16, seed=0, spread=1.0):
    return np.random.default_rng(seed).normal(0, spread, (n, width)).astype(np.float32).astype(float).tolist()


def run(spark, rows, asked, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id long") if rows and len(rows[0]) == 4 else spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in topk.search(df, df.where(df.vec_id.isin(asked)), k=k).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_GROUP", 50)
    monkeypatch.setattr(topk, "BATCH_QUERIES", 7)
    rows = [(i, v, 1, 9) for i, v in enumerate(vectors(300))]
    rows += [(300 + i, rows[0][1], 1, 9) for i in range(40)]  # many ties
    rows += [(400, None, 1, 9), (401, [1.0, None], 1, 9), (402, [float("nan")] * 16, 1, 9), (403, [float("inf")] + [0.0] * 15, 1, 9), (404, [], 1, 9), (405, [2.0, -1.0], 1, 9)]
    asked = [*range(0, 300, 20), 300, 310, 401, 404, 405]
    assert run(spark, rows, asked, 20) == brute([r[:2] for r in rows], asked, 20)


def test_few_rows_and_repeats(spark):
    rows = list(enumerate(vectors(4)))
    assert run(spark, rows, [0, 1], 20) == brute(rows, [0, 1], 20)
    assert run(spark, rows + rows[1:3], [0], 20) == brute(rows + rows[1:3], [0], 20)
    assert run(spark, rows + rows[:1], [0], 20) == brute(rows, [0], 20)
    assert run(spark, [(0, [1.0])], [0], 20) == [] and run(spark, rows[:0], [], 5) == []


@pytest.mark.parametrize("scale", [1.0, 2.0**22])
def test_tiles_prune_and_stay_exact(scale):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 50, (40, 8))
    v = np.floor(scale * (np.repeat(centers, 64, 0) + rng.normal(0, 1, (2560, 8)))).astype(np.int64)
    ids, q = np.arange(2560) * 3, v[::61]
    score, who, scored = topk.search_tile(np.full(len(q), -1), q, ids, v, 5, block=64)
    assert scored < 0.7 * len(q) * 40
    for a, s, w in zip(q, score, who):
        products = [int(x) for x in (a.astype(object) @ v.T.astype(object))]
        want = sorted((-p, int(i)) for p, i in zip(products, ids))[:5]
        assert [(-int(x), int(y)) for x, y in zip(s, w)] == want


def test_query(spark):
    from terrace.llm.queries import op10_topk

    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op10_topk(spark, sf_dir).collect()) == brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
