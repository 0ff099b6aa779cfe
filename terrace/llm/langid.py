"""Language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import map_arrow, slices, text_slices, without

NGRAMS = (1, 2, 3, 4)
SLOTS, PROBES = 1 << 20, 2
"""Slots of the filter, each a bit mask of languages (8 MB for every 64 of them, whatever the input), and slots that a gram sets in each."""
DOCS_PER_LANGUAGE = 3000
"""Labelled documents that the filter is fitted on, for each language, on average at most."""
LEAST_COUNT, LEAST_SHARE = 3, 0.2
"""A language contains a gram that its sample has at least so often, and at least this part as frequently as the language where it is most frequent."""
UNDECIDED = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: hashes of all n-grams of the texts, text by text, and the number of each text's grams. Texts are lower-cased; each run of other than letters is one blank.

    Grams lie within the text framed by blanks; those that are blank alone are left out.
    """
    points = np.frombuffer("\0".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = points == 0
    if ends.sum() != len(texts) + 1:  # a text has a NUL itself
        points = np.frombuffer("\0".join(["", *(t.replace("\0", " ") for t in texts), ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = points == 0
    alpha = letters()[points]
    keep = alpha | ends
    keep[1:] |= alpha[:-1]
    ends, alpha = ends[keep], alpha[keep]
    points = np.where(alpha, points[keep], np.uint32(32)).astype(np.uint64)
    frames = np.flatnonzero(ends)
    mixed = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = None
    for n in range(1, max(NGRAMS) + 1):
        h = mixed.copy() if n == 1 else (h[:-1] * np.uint64(0xD6E8FEB86659FD93) ^ mixed[n - 1 :])
        if n not in NGRAMS:
            continue
        m = max(0, len(points) - n + 1)
        if n == 1:
            ok = alpha.copy()
        elif n == 2:
            ok = alpha[:m] | alpha[1:]
        else:  # no frame strictly between a gram's first and last place
            ok = np.ones(m, bool)
            for d in range(1, n - 1):
                at = frames - d
                ok[at[(at >= 0) & (at < m)]] = False
        upto = np.concatenate(([0], np.cumsum(ok)))
        counts = np.diff(upto[np.minimum(frames, m)])
        x = h[ok] + np.uint64(n)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        yield x ^ (x >> np.uint64(29)), counts


@dataclass
class Filter:
    """languages: bit i % 64 of a slot's mask word i // 64 stands for the i-th (masks: a row of slots for each word); set_share: the share of slots that each has set."""

    languages: list[str]
    masks: np.ndarray
    set_share: np.ndarray

    @staticmethod
    def of_masks(languages: list[str], masks: np.ndarray) -> Filter:
        share = np.array([float((masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) for i in range(len(languages))])
        return Filter(languages, masks, share)

    @staticmethod
    def of(languages: list[str], rows: dict[str, np.ndarray], slots: int = SLOTS) -> Filter:
        masks = np.zeros((-(-max(1, len(languages)) // 64), slots), np.uint64)
        for i, name in enumerate(languages):
            for at in places(rows.get(name, np.zeros(0, np.uint64)), slots):
                masks[i // 64, at] |= np.uint64(1 << i % 64)
        return Filter.of_masks(languages, masks)

    def contains(self, h: np.ndarray) -> np.ndarray:
        """For each mask word and gram the mask of all languages that contain it (and, falsely, of others with chance set_share ** PROBES)."""
        out = None
        for at in places(h, self.masks.shape[1]):
            out = self.masks[:, at] if out is None else out & self.masks[:, at]
        return out

    def decide(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text: the share of its grams that the language contains, corrected for false positives."""
        wrong = self.set_share**PROBES
        counts, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)), np.int64)
        for h, each in grams(texts):
            masks, starts = self.contains(h), np.concatenate(([0], np.cumsum(each)))
            counts += each
            for i in range(len(self.languages)):
                ones = np.concatenate(([0], np.cumsum((masks[i // 64] >> np.uint64(i % 64)).astype(np.uint8) & 1, dtype=np.int32)))
                hits[:, i] += ones[starts[1:]] - ones[starts[:-1]]
        corrected = np.clip((hits - counts[:, None] * wrong) / np.maximum(1 - wrong, 1e-9), 0, None)
        out = []
        for n, c in zip(counts, corrected):
            if not n or not self.languages:
                out.append((UNDECIDED, 0.0))
            else:
                best = int(np.argmax(c))
                out.append((self.languages[best], float(min(1.0, c[best] / n))))
        return out


def places(h: np.ndarray, slots: int) -> list[np.ndarray]:
    bits = np.uint64(slots.bit_length() - 1)
    return [(h >> (np.uint64(64) - bits * np.uint64(p + 1))) & np.uint64(slots - 1) for p in range(PROBES)]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE) -> Filter:
    """A filter fitted on a bounded sample of the rows with a language and a text: `docs_per_language` for each language on average, chosen by the hash of id and text.

    A language has the sample's grams that are frequent enough (LEAST_COUNT, LEAST_SHARE), all of them. They set their slots where they are counted: only the filter itself, of fixed size for
    every 64 languages, is gathered. Any number of languages will do. Without a labelled row nothing is learned.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    totals = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not totals:
        return Filter.of([], {})
    share = F.element_at(F.create_map(*(F.lit(x) for t in totals for x in (t.lang, min(1.0, docs_per_language / t.n)))), F.col("lang"))
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))

    def make():
        def f(b: pa.RecordBatch):
            for a, z in text_slices(b.column(1), 1 << 22):
                langs, texts = b.column(0).slice(a, z - a).to_pylist(), b.column(1).slice(a, z - a).to_pylist()
                for lang in sorted(set(langs)):
                    own = [t for x, t in zip(langs, texts) if x == lang]
                    yield from counted(lang, own)

        def counted(lang, own):
            for lo, hi in slices([len(t) for t in own], 1 << 20):
                h, n = np.unique(np.concatenate([h for h, _ in grams(own[lo:hi])]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        return f

    counts = map_arrow(sample.select("lang", "text"), "lang string, gram long, n long", make).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    rate = counts.join(F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("all"))), "lang").withColumn("rate", F.col("n") / F.col("all"))  # one row for each language
    kept = rate.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where((F.col("n") >= LEAST_COUNT) & (F.col("rate") >= LEAST_SHARE * F.col("top")))
    languages, bits = [t.lang for t in totals], SLOTS.bit_length() - 1
    nth = F.element_at(F.create_map(*(F.lit(x) for i, lang in enumerate(languages) for x in (lang, i))), F.col("lang"))
    slot = F.explode(F.array(*(F.shiftrightunsigned("gram", 64 - bits * (p + 1)).bitwiseAND(F.lit(SLOTS - 1)).cast("int") for p in range(PROBES))))
    sliced = kept.select(nth.alias("nth"), slot.alias("slot")).groupBy(F.expr("nth div 64").cast("int").alias("word"), "slot").agg(F.expr("bit_or(shiftleft(1L, nth % 64))").alias("mask"))
    table = sliced.toArrow()  # SLOTS rows for every 64 languages at most
    masks = np.zeros((-(-len(languages) // 64), SLOTS), np.uint64)
    masks[table["word"].to_numpy(), table["slot"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    return Filter.of_masks(languages, masks)


def identify(docs: DataFrame, model: Filter, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns (all, if None), lang_pred and score of every row, over whole texts; null texts and those without letters get 'und' and 0.

    The filter is broadcast; its size is fixed. Ties go to the language that sorts first. Rows are independent. Columns named as these two give way.
    """
    keep = without(docs.columns if keep is None else keep, "lang_pred", "score")
    df = docs.select(F.col(text_col).alias("_text"), *(F.col(c) for c in keep))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def f(b: pa.RecordBatch):
            for lo, hi in text_slices(b.column(0), 1 << 19):
                part = b.slice(lo, hi - lo)
                got = shared.value.decide([t or "" for t in part.column(0).to_pylist()])
                cols = [*part.columns[1:], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score"])

        return f

    kept = ", ".join(f"`{c}` {t}" for c, t in df.dtypes[1:])
    return map_arrow(df, f"{kept}, lang_pred string, score double", make)


def held_out(id_col: str = "doc_id"):
    """One in five ids by the crc32 of their decimal digits; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
