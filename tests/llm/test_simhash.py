import random
import re

import pytest
import xxhash

from terrace.llm import simhash
from terrace.llm.common import components
from tests.llm.data import AWKWARD, PROSE, frame


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """pairs: (id, fingerprint); for each id the smallest id it is linked to."""
    root = {f: f for _, f in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = list(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        least[find(f)] = min(i, least.get(find(f), i))
    return sorted((i, f"{f:016x}", least[find(f)]) for i, f in pairs)


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = list(AWKWARD)
    base = (PROSE * 8).split()
    for _ in range(60):
        w = list(base)
        w[rng.randrange(len(w))] = rng.choice("abc")
        texts.append(" ".join(w))
    ids = [1000 - i for i in range(len(texts))]
    got = sorted(tuple(r) for r in simhash.near_duplicates(frame(spark, texts, ids=ids)).collect())
    assert got == brute_components([(i, brute_fingerprint(t)) for i, t in zip(ids, texts)])
    assert len({g[2] for g in got}) < len(got)


def test_repeated_rows_and_empty_tables(spark):
    df = frame(spark, [PROSE, None])
    got = sorted(tuple(r) for r in simhash.near_duplicates(df.union(df)).collect())
    assert got[0] == got[1] and got[2] == got[3] == (1, "0" * 16, 1)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 2])
def test_links_of_random_fingerprints(spark, radius):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    fps = list({s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(12)} | set(seeds))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.linked_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= radius for a, b in links)
    got = {r.node: r.root for r in components(simhash.linked_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), radius)).collect()}
    adjacent = {f: {g for g in fps if (f ^ g).bit_count() <= radius} for f in fps}
    for f, s in zip(fps, signed):
        seen, todo = {f}, [f]
        while todo:
            new = adjacent[todo.pop()] - seen
            seen |= new
            todo += new
        want = min(x - (1 << 64) if x >> 63 else x for x in seen)
        assert got.get(s, s) == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}


def test_query(spark, sf_dir):
    from terrace.llm.queries import op7_simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted(tuple(r) for r in op7_simhash(spark, sf_dir).collect())
    assert got == brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs])


def test_components_shapes(spark):
    """Nothing, stars (which need no step), two stars that share a leaf, a path, a ring, a bridge between components, loops and repeated edges in both directions: node by node as by following links."""
    path, ring = [(i, i + 1) for i in range(20, 33)], [(40 + i, 40 + (i + 1) % 7) for i in range(7)]
    cases = [[], [(1, 2), (1, 3), (1, 4), (9, 10)], [(1, 5), (2, 5), (2, 6)], path + ring, [*path, *ring, (46, 26), (3, 3), (33, 20), (33, 20), (20, 33)], [(7, 1), (7, 2), (7, 3), (-5, 7)]]
    for edges in cases:
        root = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in root:
            for a, b in edges:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        found = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(found) == len(root) and {r["node"]: r["root"] for r in found} == root
