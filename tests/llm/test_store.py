import random
import shutil
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import store
from terrace.llm.bpe import encoder
from terrace.llm.queries import tokenizer_path
from tests.llm.data import AWKWARD, frame

BYTE = "byte_bpe_50k.json"


def expected(rows):
    """rows: (doc_id, text) in file order."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(BYTE))
    at, out = 0, []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def cuts(ids):
    return store.cuts(store.rolling(ids).tolist(), 0, len(ids))


def test_cuts_are_stable_and_bounded():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 20_000).astype(np.uint32)
    a = cuts(ids)
    assert a[-1] == len(ids) and all(0 < y - x <= store.MOST for x, y in zip([0, *a], a))
    assert all(y - x >= store.LEAST for x, y in zip([0, *a], a[:-1]))
    b = cuts(np.concatenate((rng.integers(0, 50_000, 7).astype(np.uint32), ids)))
    assert len({c - 7 for c in b} & set(a)) > 0.8 * len(a)
    for n in (0, 1, 63, 64, 65, 3000):
        c = cuts(np.zeros(n, np.uint32))
        assert (c[-1] if c else 0) == n and all(y - x <= store.MOST for x, y in zip([0, *c], c))


def test_crc32_of_joined_parts():
    rng = random.Random(2)
    groups = [[rng.randbytes(rng.choice([0, 1, 4, 255, 1000, 8192])) for _ in range(rng.randrange(0, 6))] for _ in range(50)]
    flat = [p for g in groups for p in g]
    ends = np.cumsum([len(g) for g in groups])
    begin = ends - [len(g) for g in groups]
    got = store.crc32_joined(np.array([zlib.crc32(p) for p in flat]), np.array([len(p) for p in flat]), begin, ends)
    assert got.tolist() == [zlib.crc32(b"".join(g)) for g in groups]


def test_merkle_root_changes_with_any_leaf():
    leaves = [bytes([i]) * 32 for i in range(7)]
    root = store.merkle(leaves)
    for i in range(7):
        assert store.merkle([*leaves[:i], b"x" * 32, *leaves[i + 1 :]]) != root
    assert store.merkle(leaves[:6]) != root and store.merkle([]) != root


def test_round_trip(spark, tmp_path):
    words = ["alpha", "beta", "Straße", "<|endoftext|>", "12", "\n"]
    rng = random.Random(3)
    long = " ".join(rng.choice(words) for _ in range(5000))
    texts = [*AWKWARD, long, long, long[:9000] + " changed " + long[9000:]]
    ids = [7 * i - 20 for i in range(len(texts))]
    rng.shuffle(ids)
    out = f"file://{tmp_path}/store"
    store.write(frame(spark, texts, ids=ids), out, tokenizer_path(BYTE))
    want = expected(sorted(zip(ids, texts)))
    got = store.read_ids(spark, out).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in got] == [(*w[:3], w[4]) for w in want]
    got = store.digests(spark, out).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [w[:4] for w in want]
    chunks = store.read_chunks(spark, out).collect()
    assert len({bytes(c.key) for c in chunks}) == len(chunks)
    assert sum(c.n for c in chunks) < sum(w[2] for w in want) * 0.55
    manifest = spark.read.parquet(f"{out}/manifest").where("level = 0").collect()
    assert sum(m.n_docs for m in manifest) == len(texts) and sum(m.n_tokens for m in manifest) == sum(w[2] for w in want)


def test_tampering_is_found(spark, tmp_path):
    out = f"file://{tmp_path}/store"
    store.write(frame(spark, ["one two three", "four five"]), out, tokenizer_path(BYTE))
    chunks = store.read_chunks(spark, out).selectExpr("key", "cast(concat(body, body) as binary) body", "n")
    bad = f"{tmp_path}/bad"
    shutil.copytree(f"{tmp_path}/store", bad)
    shutil.rmtree(f"{bad}/stage")
    chunks.write.parquet(f"file://{bad}/stage/kind=chunk")
    for read in (store.read_ids, store.digests):
        with pytest.raises(Exception, match="doesn't match its key"):
            read(spark, f"file://{bad}").collect()


def test_changed_recipes_and_manifests_are_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FAN", 2)
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(600)) for _ in range(5)]
    good = f"{tmp_path}/store"
    store.write(frame(spark, texts), f"file://{good}", tokenizer_path(BYTE))
    assert store.digests(spark, f"file://{good}").count() == 5
    levels = spark.read.parquet(f"file://{good}/manifest").groupBy("level").count().orderBy("level").collect()
    assert [tuple(r) for r in levels] == [(0, 3), (1, 2), (2, 1)]
    recipes = store.read_recipes(spark, f"file://{good}")
    body = "IF(doc_id = 1, {}, body)"
    swapped = recipes.withColumn("body", F.expr(body.format("concat(substring(body, 37, 36), substring(body, 1, 36), substring(body, 73))")))
    dropped = recipes.withColumn("body", F.expr(body.format("substring(body, 37)")))
    doubled = recipes.withColumn("body", F.expr(body.format("concat(substring(body, 1, 36), body)")))
    other = recipes.withColumn("root", F.expr("IF(doc_id = 1, unhex(sha2('x', 256)), root)"))
    shifted = recipes.withColumn("start", F.expr("start + doc_id"))
    lost, twice = recipes.where("doc_id != 4"), recipes.union(recipes.where("doc_id = 1"))
    for i, bad in enumerate((swapped, dropped, doubled, other, shifted, lost, twice)):
        at = f"{tmp_path}/bad{i}"
        shutil.copytree(good, at)
        shutil.rmtree(f"{at}/recipes")
        bad.write.parquet(f"file://{at}/recipes")
        with pytest.raises(Exception, match="doesn't match|doesn't start"):
            store.verify(spark, f"file://{at}")
    for level in (0, 1, 2):
        at = f"{tmp_path}/level{level}"
        shutil.copytree(good, at)
        shutil.rmtree(f"{at}/manifest/level={level}")
        nodes = store._level(spark, f"file://{good}", level).withColumn("root", F.expr("IF(node = 0, unhex(sha2('x', 256)), root)"))
        nodes.write.parquet(f"file://{at}/manifest/level={level}")
        with pytest.raises(Exception, match="manifest doesn't match"):
            store.verify(spark, f"file://{at}")


def test_ids_that_need_more_than_16_bits_raise(spark, tmp_path):
    with pytest.raises(Exception, match="16 bits"):
        store.write(frame(spark, ["a"]), f"file://{tmp_path}/wide", tokenizer_path(BYTE), end_id=1 << 16)


def test_repeated_rows_null_ids_and_empty_tables(spark, tmp_path):
    df = frame(spark, ["a b", "a b"], ids=[4, 4])
    out = f"file://{tmp_path}/twice"
    store.write(df.union(df), out, tokenizer_path(BYTE))
    assert sorted(r.start for r in store.digests(spark, out).collect()) == [0, 3, 6, 9]
    out = f"file://{tmp_path}/none"
    store.write(df.limit(0), out, tokenizer_path(BYTE))
    assert store.digests(spark, out).count() == 0 and store.read_ids(spark, out).count() == 0
    out = f"file://{tmp_path}/null"
    store.write(spark.createDataFrame([(None, "x"), (1, None)], "doc_id long, text string"), out, tokenizer_path(BYTE))
    assert sorted((r.start, r.n_tokens) for r in store.digests(spark, out).collect()) == [(0, 2), (2, 1)]


def test_query(spark, sf_dir):
    from terrace.llm.queries import op5_store

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(tuple(r) for r in op5_store(spark, sf_dir).collect()) == [w[:4] for w in expected(rows)]
    assert encoder(tokenizer_path(BYTE)).pattern is not None


def test_a_text_is_encoded_without_leaves_up_to_the_spread(spark, monkeypatch):
    """Joins cost a tenth of the encoding; longer texts still have leaves, and ids and digests are the library's."""
    import pyarrow as pa

    from terrace.llm import bpe

    class Task:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return lambda texts: list(run(iter([pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "rid": list(range(len(texts))), "text": texts})])))

    made = []
    monkeypatch.setattr(store, "encoder", lambda *a: made.append(bpe.encoder(*a)) or made[-1])
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "Straße", "tion", "12", "!!"]) for _ in range(n)) for n in (3, 4000, 11_000, 30_000)]
    encode = store.chunked(Task(), tokenizer_path(BYTE), 0, "id", "text")
    for part in (texts[:3], texts):
        before = made[-1].joins if made else 0
        found, bodies = {}, {}
        for b in encode(part):
            for r in b.to_pylist():
                if r["kind"] == "chunk":
                    bodies[r["key"]] = r["body"]
                else:
                    found[r["doc_id"]] = [x for i in range(0, len(r["body"]), 36) for x in np.frombuffer(bodies[r["body"][i : i + 32]], "<u2").tolist()]
        assert found == {w[0]: w[4] for w in expected(enumerate(part))}
        assert (made[-1].joins - before > 0) == (len(part) > 3)


def test_rolling_hash_is_the_sum_over_each_window():
    ids = np.random.default_rng(5).integers(0, 50_000, 5000).astype(np.uint32)
    for n in (0, 1, 7, 8, 9, 5000):
        sums = [sum(int(store.MIXED[x]) * int(store.ROLL[store.WINDOW - 1 - j]) for j, x in enumerate(ids[i : i + store.WINDOW])) % 2**32 for i in range(n - store.WINDOW + 1)]
        assert store.rolling(ids[:n]).tolist() == [i + store.WINDOW for i, h in enumerate(sums) if h < 1 << (32 - store.CUT_BITS)]
