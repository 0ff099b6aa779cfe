import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from terrace.llm import mixing
from tests.llm.data import AWKWARD, frame


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Deal by weight, cut at the cap, deal the excess again, until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        unit = left / sum(w[s] for s in free)
        above = {s for s in free if unit * w[s] > most * sizes[s]}
        if not above:
            return out | {s: unit * w[s] for s in free}
        out |= {s: most * sizes[s] for s in above}
        left -= sum(most * sizes[s] for s in above)
        free -= above
    return out


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def corpus(spark, n=300):
    texts = AWKWARD + [f"w{i} " * (1 + i * 7 % 90) for i in range(n)]
    sources = [None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}" for i in range(len(texts))]
    return texts, sources, frame(spark, texts, sources=sources)


def test_targets_and_taken(spark):
    texts, sources, df = corpus(spark)
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += words(t)
    target = brute_targets(sizes)
    rows = mixing.draw(df, keep=["source"], block_words=64, shards=8).withColumn("taken", mixing.taken_words()).collect()
    assert len(rows) == len(texts)
    taken = Counter()
    for r in rows:
        assert r["size"] == words(texts[r.doc_id]) and r.source == sources[r.doc_id] and r.source_size == sizes[r.source]
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_blocks_are_disjoint_and_quotas_exact(spark):
    _, _, df = corpus(spark)
    rows = mixing.draw(df, keep=["source"], block_words=64, shards=8).select("doc_id", "source", "size", F.explode("pieces").alias("p")).select("doc_id", "source", "size", "p.*").collect()
    words_of, shard_of, slots, each = Counter(), {}, defaultdict(set), Counter()
    for r in rows:
        words_of[r.source, r.block] += r.word_to - r.word_from
        assert shard_of.setdefault((r.source, r.block), r.shard) == r.shard
        slots[r.source, r.shard].add((r.slot, r.block))
        each[r.doc_id, r["pass"]] += r.word_to - r.word_from
        assert each[r.doc_id, r["pass"]] <= r["size"]
    for s in {s for s, _ in words_of}:
        blocks = {b for x, b in words_of if x == s}
        assert blocks == set(range(len(blocks)))
        assert all(words_of[s, b] == 64 for b in blocks if b < len(blocks) - 1)
    for (_, _), found in slots.items():
        assert sorted(x for x, _ in found) == list(range(len(found)))
    per_shard = Counter(shard_of.values())
    assert max(per_shard.values()) - min(per_shard.get(i, 0) for i in range(8)) <= 3


def test_hypergeometric_inverts_the_distribution(spark):
    cases = [(n, k, m) for n, k, m in ((10, 3, 5), (40, 20, 20), (7, 7, 3), (9, 0, 4), (500, 30, 250), (1, 1, 0), (0, 0, 0))]
    rows = [(n, k, m, u / 40 + 0.0125) for n, k, m in cases for u in range(40)]
    got = spark.createDataFrame(rows, "n long, k long, m long, u double").withColumn("x", mixing.hypergeometric(F.col("n"), F.col("k"), F.col("m"), F.col("u"))).collect()
    for r in got:
        below, want = 0.0, None
        for x in range(max(0, r.m - (r.n - r.k)), min(r.k, r.m) + 1):
            below += math.comb(r.k, x) * math.comb(r.n - r.k, r.m - x) / math.comb(r.n, r.m)
            if want is None and below > r.u - 1e-12:
                want = x
        assert r.x == want, r


def test_blocks_are_permuted_by_the_seed(spark):
    sizes = [1, 2, 3, 10, 64, 997]
    rows = spark.createDataFrame([(n, x) for n in sizes for x in range(n)], "n long, x long")
    at = {}
    for seed in (1, 2):
        got = rows.withColumn("y", mixing.permuted(F.col("x"), F.col("n"), F.lit(seed), F.lit(3))).collect()
        for n in sizes:
            at[seed, n] = [r.y for r in sorted(got, key=lambda r: r.x) if r.n == n]
            assert sorted(at[seed, n]) == list(range(n))
    a, b = at[1, 997], at[2, 997]
    assert sum(x == y for x, y in zip(a, b)) < 12
    for p in (a, b):  # neither a rotation nor steps of one length
        assert max(Counter((y - x) % 997 for x, y in zip(p, p[1:])).values()) < 12 and max(Counter((y - x) % 997 for x, y in enumerate(p)).values()) < 12


def test_quotas_split_exactly(spark):
    quotas = [(i, q) for i, q in enumerate([100000, 0, 1, 5, 333, 64])]
    rows = mixing.split_quotas(spark.createDataFrame(quotas, "nth int, blocks long"), 16, 1).collect()
    assert len(rows) == 16 * len(quotas)
    for i, q in quotas:
        assert sum(r.blocks for r in rows if r.nth == i) == q and min(r.blocks for r in rows) >= 0
    each = [sum(r.blocks for r in rows if r.shard == s) for s in range(16)]
    assert max(each) - min(each) <= 4


def test_mix_gives_whole_texts_and_cut_ones(spark):
    texts, _, df = corpus(spark)
    rows = mixing.mixed(df, block_words=64, shards=8).collect()
    again = mixing.mixed(df.repartition(3), block_words=64, shards=8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert set(df.columns) < set(rows[0].asDict())
    for r in rows:
        assert r.text and r.text in texts[r.doc_id] and r.fp == r.doc_id
    for part in mixing.mixed(df, block_words=64, shards=8).select("shard", "position").rdd.glom().collect():
        assert part == sorted(part)


def test_edges(spark):
    df = frame(spark, [None, "", " "])
    assert [r.target for r in mixing.draw(df).collect()] == [0.0] * 3 and mixing.mixed(df).count() == 0
    assert mixing.draw(df.limit(0)).count() == 0
    twice = frame(spark, ["a b c"]).union(frame(spark, ["a b c"]))
    rows = mixing.draw(twice, block_words=2, shards=2).withColumn("taken", mixing.taken_words()).collect()
    assert sorted(r.taken for r in rows) in ([3, 6], [4, 5]) and sum(r.taken for r in rows) == 9


def test_query(spark, sf_dir):
    from terrace.llm.queries import op2_mixing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += words(r.text)
    target, got = brute_targets(sizes), {r.doc_id: r for r in op2_mixing(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for s in sizes:
        own = [got[r.doc_id] for r in docs if r.source == s]
        assert abs(sum(r.taken for r in own) - target[s]) <= 0.5 and math.isclose(own[0].target, target[s])
