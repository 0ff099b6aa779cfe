import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from terrace.llm import repeats
from tests.llm.data import AWKWARD, frame


def brute(texts, length=200):
    """Kept bytes, removed bytes and spans of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        last = -1
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                for j in range(max(i, last), i + length):
                    gone[j] = True
                last = i + length
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghié ") for _ in range(rng.randrange(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.choice([20, 35, 36, 37, 38, 60, 200])) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [text(rng.randrange(0, 60)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages)[rng.randrange(3) :])
        if rng.random() < 0.3:
            parts.append(rng.choice(passages))
        out.append(rng.choice(["", "|"]).join(parts))
    for t in rng.sample(out, 12):
        w = t.split(" ")
        w[rng.randrange(len(w))] = "edit"
        out += [t, " ".join(w)]
    return out


def check(spark, texts, **kw):
    got = {r.doc_id: r for r in repeats.deduplicated(frame(spark, texts, **kw)).collect()}
    assert len(got) == len(texts)
    ids = kw.get("ids") or list(range(len(texts)))
    for i, t, (n, removed, spans, kept) in zip(ids, texts, brute(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, removed, spans, kept), (i, t[:50] if t else t)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, AWKWARD + corpus(seed))


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 3)
    check(spark, corpus(3))


def test_edges(spark):
    rng = random.Random(4)
    a, b, c = ("".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in (199, 200, 201))
    check(spark, [a, a, b, b + "x", "y" + c, c, a + "é", "z" * 450, "ab" * 150, c[:100] + c, c + c, "q" + a + "r", "s" + a + "t"])
    assert repeats.deduplicated(frame(spark, [])).count() == 0
    df = frame(spark, [b, c])
    assert sorted(r.n_removed for r in repeats.deduplicated(df.union(df)).collect()) == [200, 200, 201, 201]
    nulls = spark.createDataFrame([(None, b), (None, b), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in repeats.deduplicated(nulls).collect()) == [(True, 0), (True, 200), (True, 200)]


def test_long_texts_in_slices(spark, monkeypatch):
    rng = random.Random(5)
    t = "".join(rng.choice("abcdefgh") for _ in range(3000))
    monkeypatch.setattr(repeats, "SLICE", 700)
    texts = [t[:1000] + "#" + t[1200:], t, t[500:2600], "x" * 3000, "k" + t[100:330]]
    raw = [x.encode() for x in texts]
    runs = [(w, s, n) for _, _, which, start, windows in repeats.scan(raw) for w, s, n in zip(which.tolist(), start.tolist(), windows.tolist())]
    for i, b in enumerate(raw):
        places = sorted((s, n) for w, s, n in runs if w == i)
        assert sum(n for _, n in places) == len(b) - 199 and all(a + n == c for (a, n), (c, _) in zip(places, places[1:]))
    check(spark, texts)


def brute_maximal(symbols, least):
    """(length, places) of all repeats that can't grow on both sides alike."""
    out, n = set(), len(symbols)
    for length in range(least, n):
        at = {}
        for i in range(n - length + 1):
            at.setdefault(tuple(symbols[i : i + length]), []).append(i)
        for places in at.values():
            if len(places) > 1:
                lefts = {symbols[i - 1] if i else None for i in places}
                rights = {symbols[i + length] if i + length < n else None for i in places}
                if len(lefts) > 1 and len(rights) > 1:
                    out.add((length, tuple(places)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats_are_all_found_with_all_occurrences(seed):
    rng = random.Random(seed)
    symbols = [rng.choice([0, 1] if seed % 2 else [0, 1, 2]) for _ in range(80)]
    text = np.array([*symbols, 99])
    got = {(n, tuple(sorted(p.tolist()))) for n, p in repeats.maximal_repeats(text, np.arange(len(symbols)), len(text), 4)}
    want = brute_maximal(symbols, 4)
    assert want <= got
    assert all(len({tuple(symbols[p : p + n]) for p in places}) == 1 for n, places in got)


def test_query(spark, sf_dir):
    from terrace.llm.queries import op4_repeats

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, m, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, m, s, k) in zip(docs, brute([t for _, t in docs]))}
    got = {r.doc_id: tuple(r)[1:] for r in op4_repeats(spark, sf_dir).collect()}
    assert got == want
