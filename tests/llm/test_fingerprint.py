import hashlib
import random

import pytest
from pyspark.sql import functions as F

from terrace.llm import fingerprint as fp
from tests.llm.data import AWKWARD, frame


def next_of(rows):
    """rows: (doc_id, text), ids apart; the following text in descending order of id."""
    order = sorted(rows, key=lambda r: -r[0])
    return {r[0]: order[(i + 1) % len(order)] for i, r in enumerate(order)}


def edit(t, following):
    k = len(t) // 3
    return t[: len(t) - k] + following[:k]


def check(rows, got):
    following = next_of(rows)
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows)[r.doc_id] or ""
        e = edit(t, following[r.doc_id][1] or "")
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (e == t) and (r.near_next == 1) >= (t == (following[r.doc_id][1] or ""))


def test_edit_probe_against_brute_force(spark):
    texts = AWKWARD + [f"word{i} " * (i % 40) + "tail" for i in range(80)]
    ids = random.Random(2).sample(range(-500, 10**6), len(texts))
    check(list(zip(ids, texts)), fp.edit_probe(frame(spark, texts, ids=ids)).collect())


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    texts = ["abc def ghi", "x"][:n]
    check(list(enumerate(texts)), fp.edit_probe(frame(spark, texts)).collect())


def test_repeated_and_null_ids(spark):
    df = frame(spark, ["a b c d e f", "z y x w"], ids=[5, 5])
    got = fp.edit_probe(df.union(df)).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 2
    nulls = fp.edit_probe(df.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(nulls) == 2 and nulls[0].fingerprint != nulls[1].fingerprint
    mixed = fp.edit_probe(df.union(df.withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(mixed) == 4


def syncmers(h, k=fp.K, s=fp.S):
    """Places of closed syncmers, by their definition, over any hashes of the inner substrings."""
    w = k - s + 1
    return [i for i in range(len(h) - w + 1) if min(h[i : i + w]) in (h[i], h[i + w - 1])]


def test_anchors_are_closed_syncmers(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(n)) for n in (10, 11, 40, 200)]
    df = frame(spark, texts).withColumn("u", fp.units(F.col("text")))
    df = df.withColumn("inner", F.expr("transform(sequence(0, size(u) - 2), i -> xxhash64(u[i], u[i + 1]))")).withColumn("sk", fp.sketch(F.col("u"), 10_000))
    for r in df.collect():
        places = syncmers(r.inner)
        assert {x.pos for x in r.sk} <= set(places) and len(r.sk) >= 0.5 * len(places)
        assert [x.h for x in r.sk] == sorted({x.h for x in r.sk})
        windows = {tuple(r.u[i : i + fp.K]) for i in places}
        assert len(windows) == len(r.sk)


def test_likeness_separates_edits_from_strangers(spark, sf_dir):
    from terrace.llm.queries import op3_fingerprints

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op3_fingerprints(spark, sf_dir).collect()
    check(rows, got)
    texts, following = dict(rows), next_of(rows)
    apart = [r for r in got if r.n_chars >= 300 and texts[r.doc_id] != following[r.doc_id][1]]
    assert sum(r.near_edited for r in apart) / len(apart) > 0.4
    assert sum(r.near_next for r in apart) / len(apart) < 0.1


def test_shifted_text_still_matches(spark):
    rng = random.Random(9)
    t = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300))
    df = frame(spark, [t, "new start of it " + t]).withColumn("a", fp.sketch(fp.units(F.col("text"))))
    a, b = (df.where(f"doc_id = {i}").select(F.col("a").alias(f"a{i}")) for i in (0, 1))
    assert a.crossJoin(b).select(fp.likeness(F.col("a0"), F.col("a1")).alias("x")).first().x > 0.9
