"""What several corpus operators share: Arrow batches, ordered prefix sums, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrace.storage import shared_dir, staged, unstage

__all__ = ["WHITE", "bucket_offsets", "components", "hash_bucket", "held", "map_arrow", "power_of_two", "release", "shared_dir", "slices", "staged", "text_slices", "unstage", "without", "word_count"]

WHITE = "\\x20\\x09-\\x0D"
"""White space of all word rules here, for use within a regular expression's class."""


HELD, USED = [], set()
"""Caches of this process, and those that its present task has used."""


def held(f: Callable) -> Callable:
    """f with its last result kept from task to task, until a task of map_arrow ends that hasn't asked for it: a worker outlives the operator that filled it, beside an executor that needs the memory."""
    cached = lru_cache(maxsize=1)(f)
    HELD.append(cached)

    @wraps(f)
    def call(*args, **kwargs):
        USED.add(cached)
        return cached(*args, **kwargs)

    call.cache_info, call.cache_clear = cached.cache_info, cached.cache_clear
    return call


def let_go() -> None:
    """A task's end: drop what it hasn't used, and give free memory back to the system, as the worker may now be idle for long."""
    for cached in HELD:
        if cached not in USED:
            cached.cache_clear()
    USED.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]]) -> DataFrame:
    """mapInArrow with a function that is made once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = b = out = None
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                f = f or make()
                out = f(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        finally:
            f = b = out = None
            let_go()

    return df.mapInArrow(run, schema)


def without(columns: list[str], *made: str) -> list[str]:
    """The columns but those that have the name of one that is made, in any case: the made one takes its place."""
    return [c for c in columns if c.lower() not in {m.lower() for m in made}]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to `most` or less, a larger item alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def text_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """slices of a column of texts or binaries by their bytes (null: 0), without making Python objects of them."""
    return slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most)


def word_count(text):
    """Words `[^\\x20\\x09-\\x0D]+` of a text column; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def hash_bucket(h, buckets: int):
    """The bucket of a uniform signed 64-bit hash, ascending with the hash: 0 to buckets - 1 (buckets: a power of 2)."""
    bits = buckets.bit_length() - 1
    if bits == 0:
        return F.lit(0)
    return (F.shiftright(h, 64 - bits) + F.lit(buckets // 2)).cast("int")


def bucket_offsets(df: DataFrame, keys: list[str], bucket: str, sums: dict[str, str]) -> DataFrame:
    """For each (keys, bucket): for each name of `sums` the sum of its column over all smaller buckets of the keys.

    Only a row for each bucket is sorted, so the number of buckets bounds the work of a task.
    """
    per = df.groupBy(*keys, bucket).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, bucket, *(F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)).alias(n) for n in sums))


def power_of_two(n: float, least: int = 1, most: int = 1 << 20) -> int:
    out = least
    while out < n and out < most:
        out *= 2
    return out


def release(spark: SparkSession) -> None:
    """Let go of shuffle files of steps whose results are written: Spark deletes them when the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: node, root (the smallest node of its component), for all nodes with an edge to another.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until every edge leads from a node that has no other to the smallest of its component; every step is a written table,
    so lineage stays short, and the joins read written tables, so that adaptive execution can split a hub's rows.
    """

    def stars(df: DataFrame) -> bool:
        """Whether every u has one edge and no v is a u."""
        ends = df.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(df.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").limit(1).count()

    def star(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows (u, v) with the smallest of u and its v as m."""
        least = staged(df.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc-min")
        return df.join(least, "u"), least

    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = staged(e, "cc")
    while not stars(e):
        both, least = star(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = staged(both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        both, least2 = star(large)
        small = both.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p")).where("p.v != p.m").select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).distinct()
        new = staged(small, "cc")
        for x in (e, least, large, least2):
            unstage(x)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
