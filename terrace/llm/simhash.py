"""SimHash near-duplicate classes by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import components, map_arrow, release, staged, text_slices, unstage


def simhash_of(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text: bit i is set if it is set in over half the hashes of the word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        rows = [b" ".join(words)]
    else:
        rows = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, seed) for s in rows), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


BATCH_BYTES = 1 << 21


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id_col and fp (the 64-bit fingerprint as a signed long) of every row.

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; fewer than `shingle` words make one shingle; a null text or one without
    words has fingerprint 0. Whole texts are hashed, a task holding one Arrow batch at a time.
    """

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).cast(pa.binary() if pa.types.is_string(b.column(1).type) else pa.large_binary())
            fp = np.fromiter((simhash_of(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[id_col, "fp"])

        return f

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), f"`{id_col}` {kind}, fp long", make)


def linked_pairs(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp, no repeats) that differ in `radius` or fewer bits, enough of them to connect all that are so linked.

    Radius 2 (or 1): every fingerprint emits itself and its 64 variants with one flipped bit; two fingerprints within two bits share a
    variant. All that share a variant lie within two bits of each other, so a chain through them in order loses no connection;
    a variant has at most 65 of them, so no group is large. Pairs are made distinct and their distance is verified.
    """
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    variants = classes.select("fp", F.explode(F.expr("transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))")).alias("variant"))
    w = Window.partitionBy("variant").orderBy("fp")
    if radius == 1:  # two fingerprints at one bit meet at either of the two, but others there may be two apart: pair each with the variant itself
        pairs = variants.where("variant != fp").select(F.col("variant").alias("a"), F.col("fp").alias("b")).join(classes.select(F.col("fp").alias("a")), "a", "left_semi")
    else:
        pairs = variants.select(F.lag("fp").over(w).alias("a"), F.col("fp").alias("b")).where("a is not null")
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """id_col, fingerprint (16 lowercase hex digits), component_id: the smallest id that links of `radius` or fewer bits reach, itself included.

    One row for each row of docs; repeated rows are repeated. Rows with a null or wordless text have fingerprint zero and are linked as
    any other. Copies meet in one fingerprint class before any linking. Extra columns are ignored. An empty table gives an empty one.
    """
    fp = staged(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = staged(fp.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-classes")
    roots = components(linked_pairs(classes, radius)).withColumnRenamed("node", "fp")
    inner = roots.join(classes, "fp")
    component = staged(inner.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    of = staged(classes.join(roots.join(component, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-components")
    return fp.join(of, "fp").select(F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SAMPLE, COMMON, MOST_COMMON, BLOCK = 16, 3, 200_000, 512
"""One text of SAMPLE is read for shingles that are common: in COMMON or more of them, the MOST_COMMON most frequent at most. Texts of a block."""


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles. Words and short texts as in simhash_of."""
    words = (text or b"").lower().split()
    rows = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in rows), np.uint64)).view(np.int64)


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in one order of all shingles (rare ones, then `common` ones by count; by hash), so many that sets at `similarity` or more share one of them."""
    rank = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]]


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample (th, text), sorted, and their counts. Any answer gives the same links: it only decides which shingles texts meet by."""

    def make():
        def f(b: pa.RecordBatch):
            for lo, hi in text_slices(b.column(0), BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, shingle) for t in b.column(0).slice(lo, hi - lo).to_pylist()]))], names=["token"])

        return f

    some = map_arrow(docs.where(F.pmod(F.xxhash64("th"), F.lit(SAMPLE)) == 0).dropDuplicates(["th"]).select("text"), "token long", make)
    top = some.groupBy("token").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(MOST_COMMON).toPandas().sort_values("token")
    return top["token"].to_numpy(np.int64), top["count"].to_numpy(np.int64)


def _enough(similarity: float, x: str, y: str):
    """Whether sets x and y (n: shingles, pos: place of a shared one) may still be at the similarity if they share nothing before that one. That they don't holds at the first they share."""
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return left * (1 + similarity) + 1e-9 >= similarity * (F.col(f"{x}.n") + F.col(f"{y}.n"))


PARITY_WORDS = 16
"""64-bit words of a parity sketch."""


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY_WORDS cells of hash values whether an odd number of the set's hashes lies in it: two sets differ in as many hashes at least as their parities in bits."""
    odd = np.bincount(hashes & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(similarity: float, x: str, y: str):
    """False only for sets (n: shingles, odd: parities) whose difference is too large for the similarity."""
    bits = sum((F.bit_count(F.get(f"{x}.odd", F.lit(i)).bitwiseXOR(F.get(f"{y}.odd", F.lit(i)))) for i in range(PARITY_WORDS)), F.lit(0))
    return bits * (1 + similarity) <= (1 - similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n")) + 1e-9


def _ball(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or linked by ball hashing, enough to connect all of them."""
    of = staged(classes.groupBy("fp").agg(F.min("node").alias("rep")), "neardup-fingerprints")
    same = classes.join(of, "fp").where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = linked_pairs(of.select("fp")).join(of.select(F.col("fp").alias("a"), F.col("rep").alias("of_a")), "a").join(of.select(F.col("fp").alias("b"), F.col("rep").alias("of_b")), "b")
    return same.union(near.select("of_a", "of_b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have shingle sets at the similarity: by their parities first, then both sets are made again from the texts and compared."""

    def make():
        seen = set()

        def f(b: pa.RecordBatch):
            for lo, hi in text_slices(b.column(1), BATCH_BYTES):
                part = b.slice(lo, hi - lo)
                new = {n: t for n, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if n not in seen}
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array([shingles(t, shingle) for t in new.values()], pa.list_(pa.int64()))], names=["node", "hashes"])

        return f

    of = lambda n: classes.select(F.col("node").alias(n), F.struct("n", "odd").alias(f"of_{n}"))
    pairs = staged(pairs.join(of("a"), "a").join(of("b"), "b").where(_may_link(similarity, "of_a", "of_b")).select("a", "b"), "neardup-likely")
    some = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").select("node", "least.id", "least.th"), "neardup-compared")
    texts = docs.join(some, ["id", "th"]).select("node", "text")
    sets = staged(map_arrow(texts, "node long, hashes array<long>", make), "neardup-sets")
    release(docs.sparkSession)
    side = lambda n: sets.select(F.col("node").alias(n), F.col("hashes").alias(f"of_{n}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").where(both + 1e-9 >= similarity * (F.size("of_a") + F.size("of_b") - both))
    out = staged(links.select("a", "b"), "neardup-links")
    for x in (pairs, sets, some):
        unstage(x)
    return out


def _crossing(posts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of posts (token, node, n, pos, odd, root) with a common token and different roots that may be at the similarity by places, sizes and parities; looked for in blocks of about BLOCK texts; and the staged table that they come from."""
    w = Window.partitionBy("token")
    open_ = posts.withColumn("blocks", F.ceil(F.count("*").over(w) / BLOCK).cast("int")).withColumn("lo", F.min("root").over(w)).withColumn("hi", F.max("root").over(w)).where("lo != hi")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = open_.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.struct("node", "n", "pos", "odd", "root", "mine").alias("x"))
    dealt = staged(dealt, "neardup-open")
    met = dealt.join(dealt.withColumnRenamed("x", "y"), ["token", "i", "j"])
    met = met.where((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & ((F.col("i") == F.col("j")) | (F.col("x.mine") != F.col("y.mine"))) & _enough(similarity, "x", "y") & _may_link(similarity, "x", "y"))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), dealt


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, one for each class of near-duplicates: that with the smallest id (null first), then the smallest text hash, then the smallest row.

    Texts are linked if their `shingle`-word shingle sets have a Jaccard similarity of `similarity` or more, and classes are the components of these links. No link is missed and none is estimated.
    SimHash fingerprints of the sets meet by ball hashing first, and the pairs that collide are verified on their whole sets. A fingerprint of 64 bits can't find all texts at the similarity, so there is an exact
    way for the rest: two such sets share one of their first shingles in any one order of all shingles, so texts meet by those. Common shingles come last in that order.
    Where many meet, each is compared with the smallest and the largest node first; then all that are still in different components are, in blocks that pass on only those that sizes, places and parities of the sets allow.
    Texts with equal sets share a node. Texts without words are copies of each other. Columns of any name are kept. An empty table gives an empty one.
    """
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(5)).alias("th")]
    texts = docs.select(*key, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    common, counts = _common(texts, shingle)

    def make():
        seen = set()

        def f(b: pa.RecordBatch):
            for lo, hi in text_slices(b.column(2), BATCH_BYTES):
                yield of(b.slice(lo, hi - lo))

        def of(b: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sizes, first, fp, odd = [], [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingles(t, shingle)
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                sizes.append(len(h))
                new = nodes[-1] not in seen
                seen.add(nodes[-1])
                first.append(prefix(h, similarity, common, counts) if new else None)
                fp.append(majority(h.view(np.uint64)) if new else None)
                odd.append(parities(h) if new else None)
            fp = pa.array([None if x is None else x - (x >> 63 << 64) for x in fp], pa.int64())
            node, lists = pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, pa.array(sizes, pa.int32()), pa.array(first, lists), fp, pa.array(odd, lists)], names=["id", "th", "node", "n", "first", "fp", "odd"])

        return f

    found = staged(map_arrow(texts, "id long, th long, node long, n int, first array<long>, fp long, odd array<long>", make), "neardup-rows")
    classes = staged(found.groupBy("node").agg(F.min(F.struct("id", "th")).alias("least"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("odd").alias("odd")), "neardup-classes")
    w = Window.partitionBy("token")
    post = F.struct("node", "n", "pos")
    posts = found.where("first is not null").select("node", "n", F.posexplode("first").alias("pos", "token"))
    posts = posts.withColumn("lo", F.min(post).over(w)).withColumn("hi", F.max(post).over(w)).where("lo.node != hi.node").select("token", post.alias("x"), "lo", "hi").distinct()
    posts = staged(posts, "neardup-posts")
    unstage(found)
    release(docs.sparkSession)
    star = posts.select("x", F.explode(F.array("lo", "hi")).alias("y")).where((F.col("x.node") != F.col("y.node")) & _enough(similarity, "x", "y"))
    star = star.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    star = staged(_ball(classes).union(star).distinct(), "neardup-pairs")
    release(docs.sparkSession)
    links = _verified(star, classes, texts, shingle, similarity)
    roots = components(links)
    met, dealt = _crossing(posts.select("token", "x.*").join(classes.select("node", "odd"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), similarity)
    rest = staged(met.join(star, ["a", "b"], "left_anti"), "neardup-rest")
    for x in (posts, dealt, star):
        unstage(x)
    release(docs.sparkSession)
    of = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"of_{n}"))
    between = _verified(rest, classes, texts, shingle, similarity).join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(between).select(F.col("node").alias("first"), F.col("root").alias("joined"))  # only components found first are nodes now
    grouped = classes.join(roots, "node", "left").withColumn("first", F.coalesce("root", "node")).join(joined, "first", "left")
    keeper = staged(grouped.groupBy(F.coalesce("joined", "first").alias("root")).agg(F.min("least").alias("least")).select("least.id", "least.th"), "neardup-keepers")
    for x in (classes, rest, links):
        unstage(x)
    row = docs.select(*key, F.struct(*docs.columns).alias("row"))
    kept = row.join(keeper, ["id", "th"], "left_semi").groupBy("id", "th").agg(F.min("row").alias("row"))
    return kept.select("row.*")
