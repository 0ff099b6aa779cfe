"""Removal of repeated byte strings by maximal repeats of enhanced suffix arrays, brought together by context-free anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import map_arrow, release, staged, unstage

LENGTH = 200
GRAM = 32
"""Bytes of an anchor. A window of LENGTH bytes holds LENGTH - GRAM + 1 grams; its anchor is the one with the smallest hash."""
SLICE = 1 << 18
"""Bytes that are scanned at once; longer texts are scanned in overlapping slices."""
PLACE_BITS = 20
CROWD = 4096
"""Different surroundings of one anchor (1.5 MB at most) up to which they meet in one task; beyond, its windows are dealt out by their own hashes."""
BUCKET_BYTES = 1 << 19

_rng = np.random.default_rng(4)
_TABLE = [_rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3)]
_BASE = [np.uint64(x | 1) for x in _rng.integers(1 << 60, 1 << 62, 3).tolist()]
_INVERSE = [np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASE]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a byte array, by prefix sums of table values times powers."""

    powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, b: np.ndarray, which: int):
        n = len(b) + 1
        if not Hashes.powers or len(Hashes.powers[0][0]) < n:
            size = 1 << n.bit_length()
            ones = np.ones(size, np.uint64)
            Hashes.powers = []
            for base, inverse in zip(_BASE, _INVERSE):
                up, down = ones.copy(), ones.copy()
                up[1:], down[1:] = base, inverse
                Hashes.powers.append((np.multiply.accumulate(up), np.multiply.accumulate(down)))
        up, self.down = Hashes.powers[which]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_TABLE[which][b] * up[: n - 1], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def all_of(self, length: int) -> np.ndarray:
        return mix((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(b: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other in b, text i having its window starts from first[i] to last[i]: anchor, context, text, start, windows of each run.

    A run is a stretch of consecutive windows with one anchor. Its context is a hash of all bytes of its windows and of where the anchor lies, so equal
    runs have equal anchors and contexts, wherever they are.
    """
    texts = np.flatnonzero(last >= first)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if not len(texts):
        return none
    gram = Hashes(b, 0).all_of(GRAM)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    at = (sliding_min((gram & ~mask) | np.arange(len(gram), dtype=np.uint64), LENGTH - GRAM + 1) & mask).astype(np.int64)  # the leftmost of equal ones
    owner = np.full(len(at), -1, np.int64)
    for i in texts:
        owner[first[i] : last[i] + 1] = i
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    windows = np.diff(np.append(start, len(at)))
    ok = owner[start] >= 0
    start, windows = start[ok], windows[ok]
    anchor = at[start]
    context = Hashes(b, 1).of(start, start + windows - 1 + LENGTH)
    context = mix(context + (anchor - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + windows.astype(np.uint64))
    return gram[anchor], context, owner[start], start, windows


def scan(texts: list[bytes]):
    """anchor, context, text (place in the list), start (place in the text), windows of all runs of the texts."""
    for group in _grouped(texts):
        b = np.frombuffer(b"".join(texts[i][lo:hi] for i, lo, hi in group), np.uint8)
        sizes = np.array([hi - lo for _, lo, hi in group])
        ends = np.cumsum(sizes)
        begin = ends - sizes
        anchor, context, owner, start, windows = runs(b, begin, ends - LENGTH)
        which, offset = np.array([g[0] for g in group], np.int64), np.array([g[1] for g in group], np.int64)
        yield anchor, context, which[owner], start - begin[owner] + offset[owner], windows


def _grouped(texts: list[bytes]):
    group, size = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - LENGTH + 1), SLICE):
            hi = min(len(t), lo + SLICE + LENGTH - 1)
            if hi - lo < LENGTH:
                continue
            if size + hi - lo > SLICE + LENGTH and group:
                yield group
                group, size = [], 0
            group.append((i, lo, hi))
            size += hi - lo
    if group:
        yield group


def maximal_repeats(text: np.ndarray, starts: np.ndarray, longest: int, least: int = LENGTH):
    """Groups (length, occurrences) of maximal repeats of `least` symbols or more among the suffixes of a symbol array that begin at `starts` (ascending).

    longest: no two suffixes share more symbols (symbols that occur once end what goes before). An enhanced suffix array of these suffixes: ranks by prefix doubling, and the
    common prefixes of neighbours. A stack scan finds its intervals, each with all its occurrences; one is maximal to the left if the symbols before its occurrences
    differ, where a place before that isn't among `starts`, or has no partner, differs from all.
    """
    n = len(text)
    if len(starts) < 2:
        return
    ranks, size = [np.concatenate((text + 1, np.zeros(2 * least + 2))).astype(np.int32)], 1

    def joined(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        key = a.astype(np.int64)
        key *= most + 1
        key += b
        return key

    while size * 2 <= least:
        r = ranks[-1]
        key = joined(r[: n + least], r[size : size + n + least], int(r.max()))
        ranks.append(np.append(np.unique(key, return_inverse=True)[1].astype(np.int32), np.zeros(least + 2, np.int32)))
        size *= 2
    top = ranks[-1]
    key = joined(top[starts], top[starts + least - size], int(top.max()))
    _, group, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = starts[count[group] > 1]  # a suffix without a partner at this length is in no interval
    if not len(starts):
        return
    known = np.zeros(n + 1, bool)
    known[starts] = True
    starts = starts[np.lexsort([top[np.minimum(starts + at, n)] for at in range(0, longest + 1, size)][::-1])]

    x, y = starts[:-1], starts[1:]
    lcp = np.zeros(len(x), np.int64)
    going = np.ones(len(x), bool)
    while going.any():  # whole strides first, then what is left of one, from large to small
        going &= top[np.minimum(x + lcp, n)] == top[np.minimum(y + lcp, n)]
        lcp[going] += size
    for level in range(len(ranks) - 2, -1, -1):
        lcp[ranks[level][np.minimum(x + lcp, n)] == ranks[level][np.minimum(y + lcp, n)]] += 1 << level
    before = np.maximum(starts - 1, 0)
    left = np.where((starts > 0) & known[before], text[before].astype(np.int64), -1 - np.arange(len(starts))).tolist()

    stack: list[list] = []  # length, first place, the symbol before (None: they differ)
    for i, length in enumerate([*lcp.tolist(), 0]):
        first, symbol = i, left[i]
        while stack and stack[-1][0] > length:
            depth, first, s = stack.pop()
            symbol = s if s == symbol else None
            if symbol is None:
                yield depth, starts[first : i + 1]
        if stack and stack[-1][0] == length:
            if stack[-1][2] != symbol:
                stack[-1][2] = None
        elif length >= least:
            stack.append([length, first, symbol])


def repeated_ranges(contexts: list[bytes], windows: list[int], least: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context the ranges of its bytes that maximal repeats cover, of those that begin in the first windows[i] places of context i."""
    if not contexts:
        return []
    sizes = np.array([len(c) for c in contexts]) + 1
    ends = np.cumsum(sizes)
    begin = ends - sizes
    text = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8).astype(np.int64)
    text[ends - 1] = 256 + np.arange(len(contexts))  # occurs once
    starts = np.repeat(begin, windows) + np.concatenate([np.arange(w) for w in windows])
    change = np.zeros(len(text) + 1, np.int64)
    for length, places in maximal_repeats(text, starts, int(sizes.max()), least):
        np.add.at(change, places, 1)
        np.add.at(change, places + length, -1)
    on = np.concatenate(([0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]))
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for a, b in zip(np.flatnonzero(np.diff(on) == 1).tolist(), np.flatnonzero(np.diff(on) == -1).tolist()):
        i = int(np.searchsorted(ends, a, "right"))
        out[i].append((a - int(begin[i]), b - int(begin[i])))
    return out


KEY = ["id", "th"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: the least long), th (a hash of the text), text; equal rows have equal keys."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text, F.lit(9)).alias("th"), text.cast("binary").alias("text"))


def _all_runs(rows: DataFrame) -> DataFrame:
    def make():
        def f(b: pa.RecordBatch):
            texts = b.column(2).to_pylist()
            ids, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for anchor, context, which, start, windows in scan(texts):
                cols = (ids[which], th[which], anchor.view(np.int64), context.view(np.int64), start.astype(np.int32), windows.astype(np.int32))
                for i in range(0, len(anchor), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in cols], names=["id", "th", "anchor", "context", "start", "windows"])

        return f

    return map_arrow(rows, "id long, th long, anchor long, context long, start int, windows int", make)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, spans (start, end) of the bytes of each text that a repeated LENGTH-byte string covers; only texts that have any; spans may overlap.

    1. Every window of LENGTH bytes names one anchor, the gram with the smallest hash in it. Equal windows, in whatever texts, name equal grams at equal places, so
    runs of windows meet by anchor; about one row for each 85 bytes is shuffled. 2. Anchors that occur once are done with. Of the others, runs with equal contexts (two 64-bit
    hashes) are repeats as they are; copies by the thousand are only counted. 3. One run of each different context of an anchor is taken from its text, and the contexts that share
    an anchor meet in a bucket, where their suffix array gives the maximal repeats. 4. An anchor with more than CROWD contexts (a phrase that many texts have in different surroundings)
    isn't brought to one task: its windows are counted by (anchor, place, 128-bit hash). Every step is written; joins read written tables, so hot keys can be split.
    """
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col)
    every = staged(_all_runs(rows), "repeat-runs")
    seen = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("n > 1")
    seen = staged(seen.select("anchor", (F.col("lo") != F.col("hi")).alias("varied")), "repeat-anchors")
    release(spark)
    found = staged(every.join(seen, "anchor"), "repeat-found")
    unstage(every)
    release(spark)
    contexts = staged(found.where("varied").groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "start", "windows")).alias("one")), "repeat-contexts")
    crowd = staged(contexts.groupBy("anchor").agg(F.count("*").alias("each")), "repeat-crowds")
    total = contexts.agg(F.sum(F.col("one.windows") + LENGTH)).first()[0] or 0
    wanted = contexts.join(crowd, "anchor").where("each > 1").select(F.col("one.id").alias("id"), F.col("one.th").alias("th"), F.struct("anchor", "context", F.col("one.start").alias("start"), F.col("one.windows").alias("windows"), (F.col("each") > CROWD).alias("crowded")).alias("w"))
    wanted = staged(wanted.groupBy(*KEY).agg(F.collect_list("w").alias("wanted")), "repeat-wanted")
    once = rows.join(wanted, KEY).select("text", "wanted")  # equal rows give equal pieces, so a piece may come twice; that is undone below

    def cut():
        def f(b: pa.RecordBatch):
            out, size = [], 0
            for text, ws in zip(b.column(0), b.column(1).to_pylist()):
                text = text.as_py()
                for w in ws:
                    out.append((w["anchor"], w["context"], w["windows"], w["crowded"], text[w["start"] : w["start"] + w["windows"] - 1 + LENGTH]))
                    size += len(out[-1][-1])
                    if size > 1 << 22:
                        yield batch(out)
                        out, size = [], 0
            if out:
                yield batch(out)

        def batch(out):
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["anchor", "context", "windows", "crowded", "bytes"])

        return f

    pieces = staged(map_arrow(once, "anchor long, context long, windows int, crowded boolean, bytes binary", cut), "repeat-pieces")
    release(spark)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, total // BUCKET_BYTES)

    def in_bucket(t: pa.Table) -> pa.Table:
        seen, rows = set(), []
        for a, c, w, body in zip(*(t[x].to_pylist() for x in ("anchor", "context", "windows", "bytes"))):
            if (a, c) not in seen:
                seen.add((a, c))
                rows.append((a, c, w, body))
        ranges = repeated_ranges([r[3] for r in rows], [r[2] for r in rows])
        flat = [(r[0], r[1], lo, hi) for r, rr in zip(rows, ranges) for lo, hi in rr]
        return pa.table({n: pa.array([x[i] for x in flat], t) for i, (n, t) in enumerate((("anchor", pa.int64()), ("context", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())))})

    calm = pieces.where("not crowded").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    covered = calm.groupBy("bucket").applyInArrow(in_bucket, "anchor long, context long, lo int, hi int")

    def windows_of():
        def f(b: pa.RecordBatch):
            for a, c, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                x = np.frombuffer(body, np.uint8)
                h, g = (Hashes(x, i).all_of(LENGTH) for i in (1, 2))
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.int64()), pa.array([c] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], names=["anchor", "context", "at", "h", "g"])

        return f

    windows = staged(map_arrow(pieces.where("crowded").select("anchor", "context", "bytes"), "anchor long, context long, at int, h long, g long", windows_of).distinct(), "repeat-windows")
    counted = staged(windows.groupBy("anchor", "h", "g").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeat-window-counts")
    crowded = windows.join(counted, ["anchor", "h", "g"]).select("anchor", "context", F.col("at").alias("lo"), (F.col("at") + LENGTH).cast("int").alias("hi"))
    partly = covered.union(crowded).groupBy("anchor", "context").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("one.windows") - 1 + LENGTH).cast("int").alias("hi")))
    ranges = contexts.join(staged(partly, "repeat-ranges"), ["anchor", "context"], "left").select("anchor", "context", F.when(F.col("n") > 1, whole).otherwise(F.col("ranges")).alias("ranges"))
    ranges = staged(ranges.where("ranges is not null"), "repeat-all-ranges")
    release(spark)
    same = found.where("not varied").select(*KEY, F.col("start").alias("s"), (F.col("start") + F.col("windows") - 1 + LENGTH).alias("e"))
    other = found.where("varied").join(ranges, ["anchor", "context"]).select(*KEY, "start", F.explode("ranges").alias("r")).select(*KEY, (F.col("start") + F.col("r.lo")).alias("s"), (F.col("start") + F.col("r.hi")).alias("e"))
    return same.union(other).groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) of every row.

    A byte goes if a LENGTH-byte string that covers it starts anywhere else too, in the same text or another; strings are judged on the input. Matches never cross texts.
    Null texts count as empty; texts under LENGTH bytes stay; of equal long texts nothing stays. A repeated row is another text. Extra columns are ignored. An empty table gives an empty one.
    """
    spans = staged(repeated_spans(docs, id_col, text_col), "repeat-spans")
    release(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    joined = rows.join(spans, KEY, "left").select("id", "text", "spans")
    kind = dict(docs.dtypes)[id_col]

    def make():
        def f(b: pa.RecordBatch):
            found, size, lo = [], 0, 0
            for i, (text, spans) in enumerate(zip(b.column(1), b.column(2))):
                text = text.as_py()
                found.append((len(text), *keep(text, spans)))
                size += len(text)
                if size > 1 << 22:
                    yield batch(b.column(0).slice(lo, i + 1 - lo), found)
                    found, size, lo = [], 0, i + 1
            if found:
                yield batch(b.column(0).slice(lo), found)

        def keep(text: bytes, spans) -> tuple[int, int, bytes]:
            if spans.as_py() is None:
                return 0, 0, text
            s = spans.values
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, s.field(0).to_numpy(), 1)
            np.add.at(change, s.field(1).to_numpy(), -1)
            gone = np.cumsum(change)[:-1] > 0
            starts = gone & ~np.concatenate(([False], gone[:-1]))
            return int(gone.sum()), int(starts.sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()

        def batch(ids, found):
            n, removed, spans, kept = zip(*found)
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

        return f

    out = map_arrow(joined, "id long, n_bytes long, n_removed long, n_spans long, kept binary", make)
    return out.select(F.nullif("id", F.lit(-(2**63))).cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
