import hashlib
import random

import numpy as np
import pytest

from terrace.llm import bpe
from terrace.llm.queries import tokenizer_path
from tests.llm.data import AWKWARD, frame

WORD = "word_bpe_49k.json"


def library(path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@pytest.mark.parametrize("name", [WORD, "byte_bpe_50k.json"])
@pytest.mark.parametrize("leaf", [1, 2, 7, 64])
def test_tree_encodes_as_the_library(name, leaf):
    path, rng = tokenizer_path(name), random.Random(leaf)
    tok, enc = library(path), bpe.TreeEncoder(path, leaf)
    texts = ["a" * 500, "ab" * 300, "!?" * 200, "é" * 99, "<|endoftext|>" * 3, "x<|startoftext|>Straße<|endoftext|>", "é" * 50]
    for letters in ("ab", "the inofr", "abcdefghijklmnopqrstuvwxyz", "aé日İ𝒳ß'!7"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(25)]
    for letters in ("ab  ", "it's we'll I've \n\t", "aé日ß'!7 \u2003 "):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(25)]
    for t in texts:
        assert enc.encode(t) == tok.encode(t, add_special_tokens=False).ids, t
    assert enc.encode_batch(texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", [WORD, "byte_bpe_50k.json"])
def test_every_code_point_splits_as_in_the_library(name):
    path = tokenizer_path(name)
    tok, enc = library(path), bpe.encoder(path)
    assert enc.pattern is not None
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}{c}! {c} \n" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for i in range(0, len(texts), 2000):
        part = texts[i : i + 2000]
        want = tok.encode_batch(part, add_special_tokens=False)
        bad = [j for j, (e, t) in enumerate(zip(want, part)) if e.ids != np.frombuffer(enc.encode_bytes(t), "<u4").tolist()]
        assert not bad, [hex(ord(c)) for j in bad[:5] for c in points[(i + j) * 64 : (i + j) * 64 + 64] if tok.encode(f"a{c}1{c}{c}! {c} \n", add_special_tokens=False).ids != np.frombuffer(enc.encode_bytes(f"a{c}1{c}{c}! {c} \n"), "<u4").tolist()]


@pytest.mark.parametrize("name", [WORD, "byte_bpe_50k.json"])
def test_white_space_of_all_kinds(name):
    path, rng = tokenizer_path(name), random.Random(7)
    tok, enc = library(path), bpe.encoder(path)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "It's", "é", "1", "!", " ", " ", "  ", "\n", "\t ", "\u2003", "\xa0", "\x1c", "'s", "'"]) for _ in range(rng.randrange(12)))
        assert np.frombuffer(enc.encode_bytes(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", [WORD, "byte_bpe_50k.json"])
def test_parts_join_to_what_the_whole_text_gives(name):
    path, rng = tokenizer_path(name), random.Random(11)
    tok, enc = library(path), bpe.TreeEncoder(path, 8)
    for _ in range(400):
        t = "".join(rng.choice(["a", "It's", "we'll", "é", "12", "!!", " ", "   ", "\n\n", "'r", "e", "' d", "internationalisation"]) for _ in range(rng.randrange(1, 60)))
        plain, before = enc.normalized(t), enc.joins
        places = sorted(rng.randrange(len(plain) + 1) for _ in range(5))
        whole = enc.joined([enc.part(plain[a:b]) for a, b in zip([0, *places], [*places, len(plain)])])
        assert (whole.text, whole.words) == (plain, enc.pattern[plain.isascii()].findall(plain)) and enc.joins == before + 5
        assert np.frombuffer(whole.ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
        assert sum(whole.sizes) == len(whole.ids)


@pytest.mark.parametrize("name", [WORD, "byte_bpe_50k.json"])
def test_leaves_in_many_tasks(spark, name):
    """Texts that are cut into rows, among them one run without a place to split, special tokens, and code points that only the library may split."""
    path = tokenizer_path(name)
    tok, rng = library(path), random.Random(5)
    texts = [*AWKWARD, "x" * 9001, "It's we'll " * 900, "".join(rng.choice("abé日 \n'!7") for _ in range(5000)), "<|endoftext|> a" * 300, "\U0001fae8 b" * 200, " " * 3000]
    df = frame(spark, texts)
    for leaf, spread in ((16, 100), (4096, 1000)):
        got = bpe.encode(df.union(df), path, keep=["doc_id", "fp"], leaf=leaf, spread=spread).collect()
        assert len(got) == 2 * len(texts)
        for r in got:
            assert r.fp == r.doc_id and np.frombuffer(bytes(r.ids), "<u4").tolist() == tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


def test_documents_are_joined_from_leaves(spark, sf_dir):
    enc = bpe.TreeEncoder(tokenizer_path(WORD))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 4096").collect()]
    for t in texts:
        enc.encode_bytes(t)
    assert len(texts) > 5 and enc.joins >= len(texts)


def test_words_are_kept_within_their_bytes():
    words = bpe.Words(lambda w: [1, 2, 3], 10, 10_000)
    for i in range(500):
        assert len(words[f"word{i}"]) == 12 and words.used <= 10_000 + 400
    assert len(words) < 50 and len(words["x" * 11]) == 12 and "x" * 11 not in words


def test_long_words_take_the_tree_at_the_production_leaf():
    path, rng = tokenizer_path(WORD), random.Random(3)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(50_000))
    enc = bpe.encoder(path)
    assert enc.long.search(text)
    assert enc.encode_batch([text])[0] == library(path).encode(text, add_special_tokens=False).ids


def test_round_trip_of_a_table(spark):
    path = tokenizer_path(WORD)
    tok = library(path)
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, AWKWARD), path, keep=["doc_id"]).collect()}
    assert len(got) == len(AWKWARD)
    for i, t in enumerate(AWKWARD):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids
        assert got[i].decoded == tok.decode(ids, skip_special_tokens=False)


def test_encode_then_decode_keeps_extra_columns(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    df = frame(spark, AWKWARD)
    back = bpe.decode(bpe.encode(df, path), path).collect()
    assert {(r.doc_id, r.decoded, r.fp) for r in back} == {(i, t or "", i) for i, t in enumerate(AWKWARD)}
    assert bpe.encode(df.limit(0), path).count() == 0


def test_query(spark, sf_dir):
    from terrace.llm.queries import op1_bpe

    tok = library(tokenizer_path(WORD))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
