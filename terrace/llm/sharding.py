"""Sharding by minimax contiguous partition of ordered groups of equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import bucket_offsets, hash_bucket, power_of_two, staged, unstage, without

LARGE = 64
"""Groups above a LARGE-th of a shard's mean size come first in the order; there are at most LARGE times the shards of them."""
PROBES = 16
"""Capacities that one search step tries at once."""
ROWS_PER_BUCKET = 20_000


def _large_table(spark, large: list[tuple[str, int]]) -> DataFrame:
    """key, first (place in the order) of the large groups; its size is bounded by LARGE times the number of shards."""
    rows = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(i).alias("first")) for k, i in large)) if large else F.array().cast("array<struct<key:string,first:int>>")
    return spark.range(1).select(F.explode(rows).alias("g")).select("g.key", "g.first")


def _fill(ordered: DataFrame, caps: list[int], shards: int, total: int, most: int) -> list[list[int]]:
    """For each capacity the ends (in bytes from the start) of the shards that a greedy walk fills; the walk stops early where a group doesn't fit.

    All capacities take each step together: one aggregation over the groups whose ends lie where any of them may cut.
    """
    ends: list[list[int]] = [[] for _ in caps]
    for _ in range(shards):
        at = [e[-1] if e else 0 for e in ends]
        reach = [a + c for a, c in zip(at, caps)]
        if all(a >= total for a in at):
            break
        near = ordered.where(F.col("end").between(min(reach) - most, max(reach)))
        got = near.agg(*(F.max(F.when(F.col("end") <= r, F.col("end"))).alias(f"c{i}") for i, r in enumerate(reach))).first()
        for e, a, g, r in zip(ends, at, got, reach):
            e.append(total if r >= total else max(a, g or a))
    return ends


def minimax_cuts(ordered: DataFrame, shards: int, total: int, most: int) -> list[int]:
    """The ends of the shards for the smallest capacity by which a greedy walk over the groups (column end: running sizes) fills at most `shards`.

    most: the largest group. The capacity is at least the mean and the largest group, and the mean plus the largest group always does;
    each step tries at most PROBES capacities and the upper end, which is known to do, and keeps the interval that holds the smallest feasible one.
    """
    lo = max(-(-total // shards), most)
    hi = max(lo, -(-total // shards) + most)
    best: list[int] | None = None
    while best is None or lo < hi:
        step = max(1, -(-(hi - lo) // PROBES))
        caps = [*range(lo, hi, step), hi]
        ends = _fill(ordered, caps, shards, total, most)
        i = next(i for i, e in enumerate(ends) if e and e[-1] >= total)
        best, hi = ends[i], caps[i]
        lo = caps[i - 1] + 1 if i else hi
    return best


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, `keep`, size (UTF-8 bytes of the text plus 1; null: 1), text_crc32 (unsigned; null: of no bytes), law ('bytes'), shard, slot (0, 1, ... in each shard), grown_shard (null).

    Rows with equal texts (null texts are one group, empty ones another) are never parted. Groups larger than the mean of what is left take a shard each, largest first.
    The others stand in order: those above a LARGE-th of a shard by size, then all by the hash of their text; the order is cut into contiguous shards of
    the smallest largest size. A row finds its shard by comparing its place with at most shards - 1 cuts, so neither rows nor texts are joined or moved for it.
    slot ranks a shard's rows by hash cells of their id, whose counts are summed first: no task ranks a whole shard or a whole group of copies.
    Repeated rows get slots of their own. Kept columns named as one of these give way. An empty table gives an empty one.
    """
    keep = without(keep or [], id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    spark, text = docs.sparkSession, F.col(text_col)
    rows = docs.select(
        F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"k_{c}") for c in keep)).alias("kept"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), F.coalesce(F.sha2(text, 256), F.lit("null")).alias("key"),
    )
    rows = staged(rows.withColumn("bytes", F.col("bytes") + 1), "shard-rows")
    groups = staged(rows.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total, count, number = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    large = groups.where(F.col("bytes") * (LARGE * shards) > total).orderBy(F.desc("bytes"), "key").collect()
    alone: list[str] = []
    left = total
    while large and len(alone) < shards - 1 and large[0].bytes * (shards - len(alone)) > left:
        alone.append(large[0].key)
        left -= large.pop(0).bytes
    first = [(k, i - len(alone)) for i, k in enumerate(alone)] + [(g.key, i) for i, g in enumerate(large)]
    marked = F.broadcast(_large_table(spark, first))  # at most LARGE * shards rows
    buckets = power_of_two(max(number / ROWS_PER_BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions"))), 16)
    place = F.coalesce("first", hash_bucket(F.xxhash64("key"), buckets) + len(large))

    def placed(df: DataFrame) -> DataFrame:
        return df.join(marked, "key", "left").withColumn("bucket", place).withColumn("h", F.xxhash64("key"))

    walked = placed(groups).where("bucket >= 0")
    offsets = staged(bucket_offsets(walked, [], "bucket", {"base": "bytes"}), "shard-offsets")
    inside = Window.partitionBy("bucket").orderBy("h", "key")
    ordered = walked.select("bucket", "h", "key", "bytes", F.sum("bytes").over(inside).alias("inner")).join(offsets, "bucket")
    ordered = staged(ordered.select("bucket", "h", "key", "bytes", (F.col("inner") + F.col("base")).alias("end")), "shard-ordered")
    most = ordered.agg(F.max("bytes")).first()[0]
    cuts = minimax_cuts(ordered, shards - len(alone), left, most) if most else []
    inner_cuts = sorted(set(cuts[:-1]))
    bounds = {r.end: r for r in ordered.where(F.col("end").isin(inner_cuts)).collect()} if inner_cuts else {}

    def after(c: int) -> Column:
        b = bounds[c]
        return F.struct("bucket", "h", "key") > F.struct(F.lit(b.bucket), F.lit(b.h), F.lit(b.key))

    nth = F.lit(len(alone))
    for c in cuts[:-1]:
        if c in bounds:
            nth = nth + after(c).cast("int")
    out = placed(rows).withColumn("shard", F.when(F.col("bucket") < 0, F.col("bucket") + len(alone)).otherwise(nth).cast("int"))
    cells = power_of_two(max(count / shards / ROWS_PER_BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    out = out.withColumn("cell", F.pmod(F.xxhash64("kept.id", "h"), F.lit(cells)).cast("int")).withColumn("one", F.lit(1).cast("long"))
    starts = staged(bucket_offsets(out, ["shard"], "cell", {"start": "one"}), "shard-starts")
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("kept.id", "h", "key"))
    out = out.withColumn("rank", rank.cast("long")).join(starts, ["shard", "cell"])
    unstage(groups)
    return out.select(
        F.col("kept.id").alias(id_col), *(F.col(f"kept.`k_{c}`").alias(c) for c in keep), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
