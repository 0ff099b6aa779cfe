"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over block quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import bucket_offsets, hash_bucket, power_of_two, release, staged, unstage, without, word_count

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS, SHARDS, SEED = 4096, 64, 20
ROUNDS = 24
"""Rounds of the block permutation."""
ROWS_PER_BUCKET = 20_000
RANGES = 1024
"""Stretches of a shard's shuffled order, each a task's at most."""


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x in a permutation of 0 to n - 1 that the key picks: a swap-or-not shuffle (Hoang, Morris, Rogaway 2012), of any n and without a table.

    Each round pairs x with k - x for a round's own k and swaps the two or leaves them by a bit that both share, so each round, and all of them, lose no place.
    """

    def step(a, r):
        other = F.pmod(F.xxhash64(*key, r) - a, n)
        return F.when(F.xxhash64(*key, r, F.greatest(a, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of a table (source, source_size): `share` of all sizes dealt by weight, a target ending at `most` times its source's size, the excess dealt again by weight.

    Sources by code point, null last, take the weights in turn. A source is full if its cap is below its part of what is left after all that
    fill up earlier (those with less cap for each unit of weight); this closed form equals dealing out again until none is above.
    The table has one row for each source.
    """
    w = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("all", F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(float(share)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("before", F.sum("cap").over(upto) - F.col("cap")).withColumn("w_left", F.sum("w").over(Window.partitionBy(F.lit(1))) - F.sum("w").over(upto) + F.col("w"))
    t = t.withColumn("full", (F.col("all") - F.col("before")) * F.col("w") > F.col("cap") * F.col("w_left"))
    every = Window.partitionBy(F.lit(1))
    left, w_free = F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every), F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every)
    part = F.least(F.col("cap"), F.coalesce(F.try_divide(left * F.col("w"), w_free), F.lit(0.0)))
    return t.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(part).alias("target"))


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """The number of good ones among `draws` of `total`, of which `good` are good: the inverse of the distribution at u (0 to 1).

    Weights are relative to that of the smallest value looked at, 9 standard deviations (and 3) below the mean, where one is left out
    with a chance under 1e-15; so no factorials are needed. Takes time in proportion to the standard deviation.
    """
    n, k, m = total.cast("double"), good.cast("double"), draws.cast("double")
    mean = F.coalesce(F.try_divide(m * k, n), F.lit(0.0))
    spread = F.sqrt(F.greatest(F.coalesce(F.try_divide(mean * (n - k) * (n - m), n * F.greatest(n - 1, F.lit(1.0))), F.lit(0.0)), F.lit(0.0))) * 9 + 3
    lo = F.greatest(F.lit(0).cast("long"), draws - (total - good), F.floor(mean - spread)).cast("long")
    hi = F.greatest(lo, F.least(good, draws, F.ceil(mean + spread)).cast("long"))

    def next_weight(w, x):
        x = x.cast("double")
        return w * F.coalesce(F.try_divide((k - x) * (m - x), (x + 1) * (n - k - m + x + 1)), F.lit(0.0))

    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("z"))
    span = F.sequence(lo, hi)
    z = F.aggregate(span, zero, lambda a, x: F.struct(next_weight(a["w"], x).alias("w"), (a["z"] + a["w"]).alias("z")), lambda a: a["z"])
    start = F.struct(F.lit(1.0).alias("w"), (z * u).alias("z"), lo.alias("at"))
    step = lambda a, x: F.struct(next_weight(a["w"], x).alias("w"), (a["z"] - a["w"]).alias("z"), F.when(a["z"] >= 0, x).otherwise(a["at"]).alias("at"))
    return F.aggregate(span, start, step, lambda a: a["at"])


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """shard, nth, blocks: the quotas (nth, blocks) of one row for each source split exactly among `shards` (a power of 2) shards.

    Each node of a binary tree sends half its blocks (of an odd number, a coin decides) to its left half of the shards; how many of each source is
    drawn as if its blocks were shuffled: source by source hypergeometrically, given what the earlier ones took. The rows are sources times nodes, not blocks.
    """
    pair = "struct<nth:int,blocks:long>"
    tree = quotas.select(F.struct(F.col("nth").cast("int").alias("nth"), F.col("blocks").cast("long").alias("blocks")).alias("q")).groupBy(F.lit(0).alias("node")).agg(F.array_sort(F.collect_list("q")).alias("q"))
    level = 1
    while level < shards:
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
        coin = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node")), F.lit(2))
        tree = tree.withColumn("total", total).withColumn("draws", F.expr("total div 2") + F.when(F.col("total") % 2 == 1, coin).otherwise(0))

        def step(acc, x):
            u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), x["nth"]), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
            got = F.struct(x["nth"].alias("nth"), hypergeometric(acc["total"], x["blocks"], acc["draws"], u).alias("blocks"))
            return F.transform(
                F.array(got),
                lambda g: F.struct((acc["total"] - x["blocks"]).alias("total"), (acc["draws"] - g["blocks"]).alias("draws"), F.concat(acc["out"], F.array(g)).alias("out")),
            )[0]

        zero = F.struct(F.col("total"), F.col("draws").cast("long").alias("draws"), F.array().cast(f"array<{pair}>").alias("out"))
        tree = tree.withColumn("left", F.aggregate("q", zero, step, lambda a: a["out"]))
        right = F.zip_with("q", "left", lambda x, y: F.struct(x["nth"].alias("nth"), (x["blocks"] - y["blocks"]).alias("blocks")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))
        tree = tree.select(F.explode(halves).alias("h")).select("h.node", "h.q")
        level *= 2
    return tree.select(F.col("node").alias("shard"), F.explode("q").alias("q")).select("shard", "q.nth", "q.blocks")


def draw(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None,
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """One row for each row of docs: id_col, `keep`, source, size (words; null: 0), source_size, target, and pieces: what the mix takes of it.

    The documents of a source, in the order of a hash, make a line of words, walked `most` times at most; the mix takes its first round(target) words.
    The line is cut into blocks of `block_words`; a source's exact number of blocks is split among the output shards by split_quotas, and each shard
    draws its own part of the source's permuted blocks. A piece (pass, block, shard, slot, word_from, word_to) is what a block holds of the document: words by
    place in the document, end exclusive. All shards together take every block once, so a document gives no word more than ceil(most) times.

    Null sources form a source; documents without words have no pieces; repeated rows are apart. Ties in the hash go by id and text. A hot source is walked in
    hash buckets whose offsets are summed first, so no task sorts a whole source. Reruns agree. An empty table gives an empty one.
    """
    keep = without(keep or [], id_col, "size", "source_size", "target", "pieces")
    return _drawn(docs, id_col, text_col, source_col, keep, weights, share, most, block_words, shards, seed)[0].select(
        F.col("kept.id").alias(id_col), *(F.col(f"kept.`k_{c}`").alias(c) for c in keep), *([] if source_col in [id_col, *keep] else [F.col("source").alias(source_col)]), "size", "source_size", "target", "pieces"
    )


def _drawn(docs, id_col, text_col, source_col, keep, weights=WEIGHTS, share=SHARE, most=MOST, block_words=BLOCK_WORDS, shards=SHARDS, seed=SEED) -> tuple[DataFrame, list[DataFrame]]:
    """kept (a struct of id and the columns to keep), source, size, source_size, target, pieces; and the staged tables that this reads."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"k_{c}") for c in keep)).alias("kept"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h"), F.xxhash64(text).alias("tie"),
    )
    rows = made = staged(rows, "mix-rows")
    count = rows.count()
    buckets = power_of_two(max(count / ROWS_PER_BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions"))), 16)
    rows = rows.withColumn("bucket", hash_bucket(F.col("h"), buckets))
    offsets = staged(bucket_offsets(rows, ["source"], "bucket", {"base": "size"}), "mix-offsets")
    totals = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    totals = totals.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    totals = totals.withColumn("words", F.least(F.floor(F.col("target") + 0.5), F.floor(F.col("source_size") * F.lit(float(most)))).cast("long"))
    totals = staged(totals.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long")), "mix-sources")
    parts = split_quotas(totals, shards, seed)
    ends = parts.withColumn("end", F.sum("blocks").over(Window.partitionBy("nth").orderBy("shard"))).groupBy("nth").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    plan = staged(totals.join(ends, "nth"), "mix-plan")

    within = Window.partitionBy("source", "bucket").orderBy("h", "kept.id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    line = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = lambda a, b, *c: [a[x].eqNullSafe(b[x]) for x in c]
    line = line.join(offsets, same(line, offsets, "source", "bucket"), "left").select("kept", line["source"], "size", (F.col("inner") + F.col("base")).alias("at"))
    df = line.join(plan, same(line, plan, "source"), "left").drop(plan["source"])
    passes = int(-(-most // 1))
    whole = F.transform(
        F.sequence(F.lit(0), F.lit(passes - 1)),
        lambda p: F.struct(p.alias("pass"), (p * F.col("source_size") + F.col("at")).alias("lo"), F.least(p * F.col("source_size") + F.col("at") + F.col("size"), F.col("words")).alias("hi")),
    )
    taken = F.filter(whole, lambda t: t["hi"] > t["lo"])

    def of(t):
        blocks = F.sequence(F.floor(t["lo"] / block_words), F.floor((t["hi"] - 1) / block_words))
        return F.transform(blocks, lambda b: F.struct(t["pass"].alias("pass"), b.alias("block"), permuted(b, F.col("blocks"), F.lit(seed), F.col("nth")).alias("line"), (F.greatest(b * block_words, t["lo"]) - t["lo"]).alias("word_from"), (F.least((b + 1) * block_words, t["hi"]) - t["lo"]).alias("word_to")))

    df = df.withColumn("cut", F.flatten(F.transform(taken, of)))
    pieces = F.transform(
        F.col("cut"),
        lambda c: F.transform(
            F.array(F.size(F.filter("ends", lambda e: e <= c["line"]))),
            lambda s: F.struct(c["pass"].alias("pass"), c["block"].alias("block"), s.alias("shard"), (c["line"] - F.when(s > 0, F.get("ends", s - 1)).otherwise(0)).alias("slot"), c["word_from"].alias("word_from"), c["word_to"].alias("word_to")),
        )[0],
    )
    return df.select("kept", "source", "size", "source_size", "target", pieces.alias("pieces")), [made, offsets, totals, plan]


def taken_words(pieces: str = "pieces") -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["word_to"] - p["word_from"])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mix itself: the columns of docs and shard, slot, position; a row for each piece, its text cut to the piece's words, each shard's rows in one shuffled order by position.

    A piece that is a whole document keeps its text as it is; of others the words of the piece are kept with the white space between them.
    Columns of docs named shard, slot or position give way. position orders a shard's rows: the hash of seed, shard, id, pass and first word. One shuffle
    brings rows that are near in this order together, in RANGES stretches of each shard, and they are sorted where they lie, so a shard is shuffled within itself, whichever documents stood side by side.
    """
    drawn, read = _drawn(docs, id_col, text_col, source_col, docs.columns, seed=seed, **options)
    drawn = staged(drawn.select("kept", "size", "pieces"), "mix-drawn")
    for x in read:
        unstage(x)
    release(docs.sparkSession)
    df = drawn.select("kept", "size", F.explode("pieces").alias("p"))
    text = cut_words(F.col(f"kept.`k_{text_col}`"), F.col("p.word_from"), F.col("p.word_to"), F.col("size"))
    order = F.xxhash64(F.lit(seed), F.col("p.shard"), F.col("kept.id"), F.col("p.pass"), F.col("p.word_from"))
    columns = without(docs.columns, "shard", "slot", "position")
    return df.select(*((text if c == text_col else F.col(f"kept.`k_{c}`")).alias(c) for c in columns), F.col("p.shard").alias("shard"), F.col("p.slot").alias("slot"), order.alias("position")).repartition("shard", hash_bucket(F.col("position"), RANGES)).sortWithinPartitions("shard", "position")


def cut_words(text: Column, first: Column, end: Column, size: Column) -> Column:
    """The words from first up to end of a text of `size` words; all of the text if that is all."""
    from terrace.llm.common import WHITE

    parts = F.slice(F.regexp_extract_all(text, F.lit(f"[^{WHITE}]+[{WHITE}]*"), F.lit(0)), (first + 1).cast("int"), (end - first).cast("int"))
    return F.when((first == 0) & (end == size), text).otherwise(F.array_join(parts, ""))
