"""Token-id output: a content-addressed store of id chunks, document recipes, and Merkle manifests."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.bpe import SPREAD, encoder
from terrace.llm.common import bucket_offsets, map_arrow, slices, text_slices
from terrace.storage import with_row_id

WINDOW, LEAST, CUT_BITS, MOST = 8, 64, 8, 2048
"""Ids that the rolling hash sees; ids in a chunk at least; a place is a cut if so many bits of its hash are 0; ids in a chunk at most."""
MIXED = (np.arange(1 << 16, dtype=np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
MIXED ^= MIXED >> np.uint32(15)
ROLL = [np.uint32(pow(0x9E3779B1, i, 1 << 32)) for i in range(WINDOW)]
BATCH_CHARS = 1 << 20
FAN = 1024
"""Documents of a part, and children of a node of the manifest's tree, at most."""
SEEN = 1 << 18
"""Digests that a task remembers, so as not to send a chunk again."""
PLAIN = {"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"}
"""Keys and bodies are all different, so a dictionary of them is never kept."""
STORE_WORDS = 256 << 20
"""Memory for the pre-tokens whose ids a worker remembers: one that is encoded again takes many times as long as one that is found."""


def rolling(ids: np.ndarray) -> np.ndarray:
    """Places (ends) whose last WINDOW ids hash to a cut, over a whole array of streams: a stream's first LEAST ids are never looked at, so its neighbours don't matter."""
    h, n = MIXED[ids], 1
    while n < WINDOW and len(h):  # from windows of n ids to those of 2n: the sum of all by falling powers stays the same
        h = h[:-n] * ROLL[n] + h[n:]
        n *= 2
    return np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + WINDOW


def cuts(found: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the stream from begin to end: LEAST to MOST ids apart where the rolling hash says so (found: its places inside). A change moves only nearby cuts."""
    out, at = [], begin
    for c in (*found, end):
        while c - at > MOST:
            at += MOST
            out.append(at)
        if c - at >= LEAST or c == end and c > at:
            out.append(c)
            at = c
    return out


def merkle(digests: list[bytes]) -> bytes:
    """The root of a binary Merkle tree over SHA-256 digests: pairs are hashed with a 1 before them, an odd one goes up as it is; none: the hash of nothing.

    A chunk has an even number of bytes and a pair with its 1 an odd one, so neither passes for the other.
    """
    if not digests:
        return hashlib.sha256(b"").digest()
    row = digests
    while len(row) > 1:
        row = [hashlib.sha256(b"\1" + row[i] + row[i + 1]).digest() if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0]


ROWS = "kind string, key binary, body binary, n long, doc_id long, root binary"


def chunked(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: chunk (key: SHA-256 of body; body: n ids, 2 bytes each) and recipe (key: unlike any other; body: key and count of each chunk in order; n ids; root)."""

    def make():
        enc, end = encoder(path, SPREAD, STORE_WORDS), end_id.to_bytes(4, "little")  # a text of up to SPREAD goes without leaves and their joins
        seen: set[bytes] = set()

        def f(b: pa.RecordBatch):
            ids, rid = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in text_slices(b.column(2), BATCH_CHARS):
                streams = [enc.encode_bytes(t or "") + end for t in b.column(2).slice(lo, hi - lo).to_pylist()]
                stream = np.frombuffer(b"".join(streams), "<u4")
                if stream.max(initial=0) > 0xFFFF:
                    raise ValueError("a token id takes more than 16 bits")
                data, places = stream.astype("<u2").tobytes(), rolling(stream)
                ends = np.cumsum([len(s) // 4 for s in streams])
                inside = np.searchsorted(places, ends, "left").tolist()
                places, rows, at, k = places.tolist(), [], 0, 0
                for doc_id, r, e, last in zip(ids[lo:hi], rid[lo:hi], ends.tolist(), inside):
                    recipe, keys, begin = [], [], at
                    for c in cuts(places[k:last], at, e):
                        body = data[2 * at : 2 * c]
                        key = hashlib.sha256(body).digest()
                        recipe.append(key + (c - at).to_bytes(4, "little"))
                        keys.append(key)
                        if key not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(key)
                            rows.append(("chunk", key, body, c - at, None, None))
                        at = c
                    k = last
                    rows.append(("recipe", b"recipe" + r.to_bytes(8, "little"), b"".join(recipe), e - begin, doc_id, merkle(keys)))
                yield out(rows)

        def out(rows):
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["kind", "key", "body", "n", "doc_id", "root"])

        return f

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.monotonically_increasing_id(), F.col(text_col)), ROWS, make)


def write(docs: DataFrame, out: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs (null texts as empty), append end_id to each, and write the store below `out`, a folder that all executors share.

    stage/kind=chunk/: each distinct chunk once (key, body, n), found by key. recipes/: in ascending order of id (null first, equal ids by their recipe): part (FAN documents each), nth in it,
    doc_id, start (ids of all documents before it), n_tokens, root (Merkle root of its chunks' keys), body. manifest/level=0: for each part the number of documents and ids and
    the Merkle root of its documents' roots; level=1 and so on: the same of FAN nodes below, up to one node, whose root stands for the whole store. No task holds more than FAN roots.
    One shuffle moves each chunk that a task hasn't sent yet (so a chunk comes once from each task, however many documents share it), and only behind it are rows sorted by key; recipes are small.
    A token id of 65,536 or more raises. Repeated rows have a recipe each.
    """
    spark = docs.sparkSession
    rows = chunked(docs, path, end_id, id_col, text_col)
    rows.repartition("key").dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "zstd").options(**PLAIN).parquet(f"{out}/stage")
    staged = spark.read.schema("key binary, body binary, n long, doc_id long, root binary, kind string").parquet(f"{out}/stage")
    recipes = with_row_id(staged.where("kind = 'recipe'").drop("kind"), ["doc_id", "root", "key"], "at")
    recipes = recipes.withColumn("part", F.expr(f"at div {FAN}")).withColumn("nth", F.col("at") % FAN)
    before = bucket_offsets(recipes, [], "part", {"base": "n"})
    w = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.withColumn("inner", F.coalesce(F.sum("n").over(w), F.lit(0))).join(before, "part")
    placed.select("part", "nth", "doc_id", (F.col("base") + F.col("inner")).alias("start"), F.col("n").alias("n_tokens"), "root", "body").write.parquet(f"{out}/recipes")

    nodes, level = _nodes(read_recipes(spark, out).select("part", "nth", F.lit(1).cast("long").alias("n_docs"), "n_tokens", "root")), 0
    while True:
        nodes.write.parquet(f"{out}/manifest/level={level}")
        nodes = _level(spark, out, level)
        if nodes.count() <= 1:
            return
        nodes, level = _nodes(_children(nodes)), level + 1


def _nodes(children: DataFrame) -> DataFrame:
    """node, n_docs, n_tokens, root (Merkle root of the children's, by nth) of rows (part, nth, n_docs, n_tokens, root): FAN children of a part at most."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [merkle([r["root"] for r in x]) for x in b.column(3).to_pylist()]
            return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.binary())], names=["node", "n_docs", "n_tokens", "root"])

        return f

    per = children.groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("nth", "root"))).alias("roots"))
    return map_arrow(per, "node long, n_docs long, n_tokens long, root binary", make)


def _children(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.expr(f"node div {FAN}").alias("part"), (F.col("node") % FAN).alias("nth"), "n_docs", "n_tokens", "root")


def _level(spark: SparkSession, out: str, level: int) -> DataFrame:
    return spark.read.schema("node long, n_docs long, n_tokens long, root binary").parquet(f"{out}/manifest/level={level}")


def verify(spark: SparkSession, out: str) -> None:
    """Raises unless every document's root and count are those of its recipe, the starts follow each other, and each node of the manifest is that of what lies below it, up to the top.

    So a chunk that is exchanged, left out or doubled in a recipe, a recipe that is lost, doubled or moved, and a changed manifest are found; what a chunk holds is held against its key where it is read.
    """

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            for n, root, body in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(6).to_pylist()):
                if merkle([body[i : i + 32] for i in range(0, len(body), 36)]) != root or sum(int.from_bytes(body[i + 32 : i + 36], "little") for i in range(0, len(body), 36)) != n:
                    raise ValueError("a recipe doesn't match its root")
            return pa.RecordBatch.from_arrays([*b.columns[:3], b.column(3), b.column(4)], names=["part", "nth", "n_docs", "n_tokens", "root"])

        return f

    recipes = read_recipes(spark, out)
    found = map_arrow(recipes.select("part", "nth", F.lit(1).cast("long").alias("n_docs"), "n_tokens", "root", "start", "body"), "part long, nth long, n_docs long, n_tokens long, root binary", make)
    level = 0
    while True:
        made, said = _nodes(found), _level(spark, out, level)
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n_docs", "n_tokens", "root")]
        if made.alias("a").join(said.alias("b"), F.col("a.node") == F.col("b.node"), "full").where(~(same[0] & same[1] & same[2])).limit(1).count():
            raise ValueError("the manifest doesn't match its documents")
        if said.count() <= 1:
            break
        found, level = _children(said), level + 1
    w = Window.partitionBy("part").orderBy("nth")
    steps = recipes.withColumn("was", F.lag(F.col("start") + F.col("n_tokens")).over(w)).withColumn("last", F.lag("nth").over(w))
    base = bucket_offsets(recipes, [], "part", {"base": "n_tokens"})
    wrong = steps.join(base, "part").where((F.col("start") != F.coalesce("was", "base")) | (F.col("nth") != F.coalesce(F.col("last") + 1, F.lit(0))))
    if wrong.limit(1).count():
        raise ValueError("a document doesn't start where the one before it ends")


def read_recipes(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("part long, nth long, doc_id long, start long, n_tokens long, root binary, body binary").parquet(f"{out}/recipes")


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("key binary, body binary, n long, kind string").parquet(f"{out}/stage").where("kind = 'chunk'").drop("kind")


def _parts(recipes: DataFrame) -> DataFrame:
    """A row for each place of a chunk in a document: part, nth (the document), at (its place), key, len (ids)."""
    n = F.expr("cast(length(body) div 36 as int)")
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("at"), F.substring("body", i * 36 + 1, F.lit(32)).alias("key")))
    return recipes.where(F.length("body") > 0).select("part", "nth", F.explode(places).alias("p")).select("part", "nth", "p.at", "p.key")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array) of every document, rebuilt from its chunks; a chunk that doesn't hash to its key or is missing, a wrong count, and all that verify finds raise."""
    verify(spark, out)
    recipes, chunks = read_recipes(spark, out), read_chunks(spark, out)
    good = chunks.select("key", F.when(F.unhex(F.sha2("body", 256)) == F.col("key"), F.col("body")).otherwise(F.raise_error(F.lit("a chunk doesn't match its key"))).alias("chunk"))
    bodies = _parts(recipes).join(good, "key", "left").groupBy("part", "nth").agg(F.array_sort(F.collect_list(F.struct("at", "chunk"))).alias("chunks"))

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = []
            for n, chunks in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if any(c["chunk"] is None for c in chunks or []):
                    raise ValueError("a chunk is missing")
                x = np.frombuffer(b"".join(c["chunk"] for c in chunks or []), "<u2")
                if len(x) != n:
                    raise ValueError("a document has another length than its recipe says")
                ids.append(x.astype(np.int32))
            return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])

        return f

    return map_arrow(recipes.join(bodies, ["part", "nth"], "left").select("doc_id", "start", "n_tokens", "chunks"), "doc_id long, start long, n_tokens long, ids array<int>", make)


def _moved(crc: np.ndarray, op: np.ndarray) -> np.ndarray:
    """Each crc times a matrix over bits: op holds the images of the single bits."""
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where(crc >> np.uint32(bit) & np.uint32(1), op[bit], np.uint32(0))
    return out


def _zeros(lengths: np.ndarray) -> np.ndarray:
    """What n zero bytes do to the 32 bits of a crc32, as the images of the single bits, for each n of lengths: (len(lengths), 32). All lengths take each power of 2 together."""
    op = np.array([0xEDB88320] + [1 << i for i in range(31)], np.uint32)  # one zero bit
    for _ in range(3):
        op = _moved(op, op)  # one zero byte, after three squares
    out = np.tile(np.uint32(1) << np.arange(32, dtype=np.uint32), (len(lengths), 1))
    left = lengths.astype(np.int64)
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _moved(out[odd], op)
        op, left = _moved(op, op), left >> 1
    return out


def crc32_joined(crcs: np.ndarray, sizes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 of each concatenation of parts: crcs and sizes (bytes) of all parts, of which group i has those from begin[i] to end[i].

    All groups take their next part together; the crc32 so far moves on by the part's size as by zero bytes.
    """
    lengths, which = np.unique(sizes, return_inverse=True)
    moves = _zeros(lengths)
    out = np.zeros(len(begin), np.uint32)
    for step in range(int((end - begin).max(initial=0))):
        on = np.flatnonzero(begin + step < end)
        part = begin[on] + step
        crc, m = out[on], moves[which[part]]
        moved = crcs[part].astype(np.uint32)
        for bit in range(32):
            moved ^= np.where(crc >> np.uint32(bit) & np.uint32(1), m[:, bit], np.uint32(0))
        out[on] = moved
    return out


def digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Every chunk is read, held against its key, and its crc32 (of the ids as 4 bytes each) taken where it lies; a document's crc32 is composed from those of its chunks.
    So the ids themselves, read in full, aren't moved again, and a chunk that thousands of documents share is looked at once. Recipes and manifest are verified first.
    """
    verify(spark, out)

    def check():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            keys, bodies = b.column(0).to_pylist(), b.column(1).to_pylist()
            if any(hashlib.sha256(body).digest() != key for key, body in zip(keys, bodies)):
                raise ValueError("a chunk doesn't match its key")
            crc, n = [], [len(body) // 2 for body in bodies]
            for lo, hi in slices([len(body) for body in bodies], BATCH_CHARS):
                wide, at = memoryview(np.frombuffer(b"".join(bodies[lo:hi]), "<u2").astype("<u4").tobytes()), 0
                for m in n[lo:hi]:
                    crc.append(zlib.crc32(wide[at : at + 4 * m]))
                    at += 4 * m
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int32())], names=["key", "crc", "len"])

        return f

    recipes = read_recipes(spark, out)
    sums = map_arrow(read_chunks(spark, out).select("key", "body"), "key binary, crc long, len int", check)
    parts = _parts(recipes).join(sums, "key", "left").groupBy("part", "nth").agg(F.array_sort(F.collect_list(F.struct("at", "crc", "len"))).alias("parts"))

    def compose():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            parts, n = b.column(3), b.column(2).to_numpy()
            flat, ends = parts.flatten(), np.cumsum(np.nan_to_num(parts.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            begin = ends - np.diff(ends, prepend=0)
            crc, size = flat.field("crc"), flat.field("len")
            if crc.null_count:
                raise ValueError("a chunk is missing")
            size = size.to_numpy().astype(np.int64)
            if (np.diff(np.append(0, np.cumsum(size))[np.append(0, ends)]) != n).any():
                raise ValueError("a document has another length than its recipe says")
            found = crc32_joined(crc.to_numpy(), 4 * size, begin, ends).astype(np.int64)
            return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return f

    joined = recipes.select("part", "nth", "doc_id", "start", "n_tokens").join(parts, ["part", "nth"], "left").select("doc_id", "start", "n_tokens", "parts")
    return map_arrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long", compose)
