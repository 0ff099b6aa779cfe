import zlib
from collections import Counter, defaultdict

import pytest

from terrace.llm import sharding
from tests.llm.data import AWKWARD, frame


def check(texts, got, shards):
    assert len(got) == len(texts)
    of, slots, load = {}, defaultdict(list), Counter()
    for r in got:
        t = texts[r.doc_id]
        raw = (t or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert of.setdefault(t, r.shard) == r.shard and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_sizes_near_equal(spark):
    texts = [f"t{i} " * (1 + i * 13 % 50) for i in range(3000)]
    load = check(texts, sharding.shard(frame(spark, texts), 8).collect(), 8)
    assert len(load) == 8 and max(load.values()) <= 1.02 * min(load.values())


def test_hot_group_stays_whole_and_the_rest_is_even(spark):
    texts = AWKWARD + ["hot text " * 20] * 900 + ["warm " * 20] * 150 + [f"t{i} " * 9 for i in range(4000)]
    load = check(texts, sharding.shard(frame(spark, texts), 8).collect(), 8)
    rest = sorted(load.values())[:-1]
    assert len(load) == 8 and rest[-1] <= 1.05 * rest[0]


def smallest_capacity(sizes, shards):
    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed", range(4))
def test_cuts_are_minimax(spark, seed):
    import random

    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50, rng.randrange(1, 400)]) for _ in range(60)]
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    ordered = spark.createDataFrame([(e,) for e in ends], "end long")
    cuts = sharding.minimax_cuts(ordered, 5, ends[-1], max(sizes))
    loads = [b - a for a, b in zip([0, *cuts], cuts)]
    assert set(cuts) <= set(ends) and max(loads) == smallest_capacity(sizes, 5) and cuts[-1] == ends[-1]


def test_search_ends_at_any_capacity(monkeypatch):
    """Whatever the smallest capacity is, the probes hold one that does."""
    for most in (18, 31, 1000, 100_000):
        lo = most
        for answer in {*range(lo, lo + most, max(1, most // 900)), lo + most // 2 + 1}:
            monkeypatch.setattr(sharding, "_fill", lambda _o, caps, _s, total, _m, answer=answer: [[c, total if c >= answer else 0] for c in caps])
            assert sharding.minimax_cuts(None, 5, 5 * most, most)[0] == answer


@pytest.mark.parametrize("texts", [[], [None], ["a", "a", "a"], ["", None, "", "b"], ["x" * 100] + ["a", "b"]])
def test_few_rows(spark, texts):
    check(texts, sharding.shard(frame(spark, texts), 8).collect(), 8)


def test_repeated_rows_reruns_and_kept_columns(spark):
    df = frame(spark, ["a b", "c"])
    rows = sharding.shard(df.union(df), 4, keep=["text", "source", "size"]).collect()
    assert len(rows) == 4 and len({(r.shard, r.slot) for r in rows}) == 4 and {r.text for r in rows} == {"a b", "c"}
    key = lambda f: sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard(f, 4).collect())
    assert key(df) == key(df.repartition(3))


def test_query(spark, sf_dir):
    from terrace.llm.queries import op6_sharding

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    load = check(texts, op6_sharding(spark, sf_dir).collect(), 8)
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= max(len(t.encode()) for t in texts.values()) * 3
