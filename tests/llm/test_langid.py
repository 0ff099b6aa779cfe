import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from terrace.llm import langid
from tests.llm.data import AWKWARD, frame

EN = ["the house is by the sea and the weather was with them", "this is what they have thought when there was nothing"]
DE = ["der hund ist nicht bei den kindern und sie schlafen schon", "das ist ein schönes haus auf der straße und ich bleibe"]
FR = ["le chien est dans la maison avec les enfants qui jouent", "nous avons été très heureux de voir cette ville où il pleut"]


def brute_grams(t):
    """A list of n-grams, by walking the text."""
    s = ""
    for c in t.lower():
        if c.isalpha():
            s += c
        elif s and s[-1] != " ":
            s += " "
    framed = "^" + s + "^"
    out = []
    for n in langid.NGRAMS:
        for i in range(len(framed) - n + 1):
            g = framed[i : i + n]
            if n == 1 and not g.isalpha() or n > 1 and not any(c.isalpha() for c in g):
                continue
            out.append(g.replace("^", " "))
    return out


def all_of(texts):
    """Hashes of all grams, and the number of each text's."""
    parts = list(langid.grams(texts))
    return np.concatenate([h for h, _ in parts]), sum(c for _, c in parts)


def test_grams_are_those_of_a_walk():
    texts = [t or "" for t in AWKWARD if t is None or len(t) < 300] + EN + ["a\0b", "1a2", "--", "É é", "ab", "a", "abc", "ab c"]
    h, counts = all_of(texts)
    assert [len(brute_grams(t)) for t in texts] == counts.tolist() and len(h) == counts.sum()
    for n, (h, c) in zip(langid.NGRAMS, langid.grams(texts)):
        at = 0
        for t, k in zip(texts, c):
            alone = next(x for m, (x, _) in zip(langid.NGRAMS, langid.grams([t])) if m == n)
            assert sorted(alone) == sorted(h[at : at + k])
            at += k
    one = all_of(["the cat the cat"])[0]
    assert len(np.unique(one)) == len(set(brute_grams("the cat the cat")))


def test_filter_finds_all_and_corrects_false_positives():
    rng = np.random.default_rng(1)
    a, b, other = (rng.integers(0, 2**64, 400, np.uint64) for _ in range(3))
    f = langid.Filter.of(["a", "b"], {"a": a, "b": np.concatenate((a[:50], b))}, slots=1 << 10)
    assert (f.contains(a)[0] & np.uint64(1)).all() and (f.contains(np.concatenate((a[:50], b)))[0] & np.uint64(2)).all()
    wrong = (f.contains(rng.integers(0, 2**64, 20_000, np.uint64))[0] & np.uint64(1)).mean()
    assert abs(wrong - f.set_share[0] ** langid.PROBES) < 0.03 and len(other) == 400


def test_decides_and_rejects(spark, monkeypatch):
    monkeypatch.setattr(langid, "LEAST_COUNT", 1)
    texts, langs = EN + DE + FR + [None, "", "123 !?"], ["en"] * 2 + ["de"] * 2 + ["fr"] * 2 + ["en", None, "fr"]
    df = frame(spark, texts, langs=langs)
    model = langid.fit(df)
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == langs[:6] and all(0 < got[i].score <= 1 for i in range(6))
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (6, 7, 8))
    assert got[0].fp == 0 and got[0].lang == "en"
    clash = langid.identify(df.withColumn("Score", F.lit(7)), model).columns
    assert clash == [*df.columns, "lang_pred", "score"]
    more = langid.identify(frame(spark, AWKWARD), model, keep=["doc_id"]).collect()
    assert len(more) == len(AWKWARD)
    assert langid.identify(df.limit(0), langid.fit(df.limit(0))).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.fit(df.limit(0))).collect()} == {"und"}


def test_prediction_ignores_labels(spark):
    model = langid.fit(frame(spark, EN * 3 + DE * 3, langs=["en"] * 6 + ["de"] * 6))
    a = langid.identify(frame(spark, EN + DE), model, keep=["doc_id"]).collect()
    b = langid.identify(frame(spark, EN + DE).withColumn("lang", F.lit("fr")).withColumn("source", F.lit("q")), model, keep=["doc_id"]).collect()
    assert sorted(a) == sorted(b)


def test_held_out_accuracy(spark):
    from terrace.llm.queries import op9_language

    sf_dir = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op9_language(spark, sf_dir).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) / len(test) > 0.97


def brute_hash(g):
    m, h = 2**64 - 1, 0
    for i, c in enumerate(g):
        x = (ord(c) + 1) * 0x9E3779B97F4A7C15 & m
        h = (h * 0xD6E8FEB86659FD93 & m) ^ x if i else x
    h = h + len(g) & m
    h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & m
    return h ^ h >> 29


def brute_slots(h):
    bits = langid.SLOTS.bit_length() - 1
    return [h >> 64 - bits * (p + 1) & langid.SLOTS - 1 for p in range(langid.PROBES)]


def brute_fit(texts, langs):
    """For each language the slots that its grams set: counts, rates and the two rules, gram by gram."""
    count = {x: Counter(g for t, y in zip(texts, langs) if y == x and t for g in brute_grams(t)) for x in sorted({x for x, t in zip(langs, texts) if x and t is not None})}
    total = {x: sum(c.values()) for x, c in count.items()}
    slots = {}
    for x, c in count.items():
        kept = [g for g, n in c.items() if n >= langid.LEAST_COUNT and n / total[x] >= langid.LEAST_SHARE * max(count[y][g] / total[y] for y in count)]
        slots[x] = {s for g in kept for s in brute_slots(brute_hash(g))}
    return slots


def brute_decide(text, slots):
    grams = brute_grams(text or "")
    if not grams or not slots:
        return "und", 0.0
    best = (-1.0, "")
    for x in slots:
        wrong = (len(slots[x]) / langid.SLOTS) ** langid.PROBES
        hits = sum(all(s in slots[x] for s in brute_slots(brute_hash(g))) for g in grams)
        share = max(0.0, (hits - len(grams) * wrong) / max(1 - wrong, 1e-9)) / len(grams)
        if share > best[0] + 1e-12:
            best = (share, x)
    return best[1], min(1.0, best[0])


def corpus(names, n, seed):
    """Each language draws its words from a vocabulary of its own, some words of all."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(1, 7)))
    shared = [word() for _ in range(10)]
    vocabulary = {x: [word() for _ in range(25)] + shared for x in names}
    langs = [names[i % len(names)] for i in range(n)]
    return [" ".join(rng.choice(vocabulary[x]) for _ in range(rng.randrange(5, 60))) for x in langs], langs


def test_fit_and_identify_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "SLOTS", 1 << 12)  # so that false positives count
    texts, langs = corpus(["da", "en", "it"], 60, 1)
    more = [None, "", "12 !!", "quite another text", "É ß"]
    df = frame(spark, texts + more, langs=langs + ["en", None, "it", None, "da"])
    model, slots = langid.fit(df, docs_per_language=10**6), brute_fit(texts + more, langs + ["en", None, "it", None, "da"])
    assert model.languages == sorted(slots)
    for i, x in enumerate(model.languages):
        assert set(np.flatnonzero(model.masks[0] >> np.uint64(i) & np.uint64(1)).tolist()) == slots[x]
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    for i, t in enumerate(texts + more):
        lang, score = brute_decide(t, slots)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-9, t


def test_more_than_64_languages(spark):
    names = [f"l{i:02d}" for i in range(70)]
    texts, langs = corpus(names, 700, 2)
    df = frame(spark, texts, langs=langs)
    model = langid.fit(df)
    assert model.languages == names and model.masks.shape == (2, langid.SLOTS)
    got = langid.identify(df, model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(texts)
