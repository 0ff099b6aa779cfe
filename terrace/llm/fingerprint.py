"""Document fingerprints from closed syncmers, for positional matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import WHITE

UNIT, K, S, KEEP = 8, 5, 2, 64
"""Code points in a unit at most; units in a k-mer and in its inner substrings; anchors in a fingerprint."""


def units(text: Column, unit: int = UNIT) -> Column:
    """Hashes of a text's units: each word, longer words cut every `unit` code points. So places follow the words, and text without spaces has units too."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"[^{WHITE}]{{1,{unit}}}"), F.lit(0)), lambda x: F.xxhash64(x))


def sketch(u: Column, keep: int = KEEP) -> Column:
    """The `keep` anchors with the smallest hashes, as an array of (h, pos) by h, each hash at its first place.

    Anchors are the closed syncmers of K units with inner substrings of S: a k-mer is one if the smallest of its K - S + 1 substring hashes is the first or the
    last, which depends on nothing outside it. A text of under 2 K units has all its units as anchors.
    """

    def of(u):
        n = F.size(u)

        def of_s(s):
            at = lambda i, d: F.get(s, i + d)
            edge = lambda i: F.least(at(i, 0), at(i, K - S)) <= F.least(*(at(i, d) for d in range(1, K - S)))
            chosen = F.filter(F.sequence(F.lit(0), n - K), edge)
            return F.transform(chosen, lambda i: F.struct(F.xxhash64(at(i, 0), at(i, S), F.get(u, i + K - 1)).alias("h"), i.alias("pos")))

        pairs = F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(F.get(u, i), F.get(u, i + 1)))
        long = _let(pairs, of_s)
        short = F.transform(u, lambda x, i: F.struct(x.alias("h"), i.alias("pos")))
        ordered = F.array_sort(F.when(n >= 2 * K, long).otherwise(short))
        return _let(ordered, lambda a: F.slice(F.filter(a, lambda x, i: (i == 0) | (F.get(a, F.greatest(i - 1, F.lit(0)))["h"] != x["h"])), 1, keep))

    return _let(u, of)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def as_text(sk: Column) -> Column:
    return F.concat_ws(",", F.transform(sk, lambda x: F.concat(F.lower(F.lpad(F.hex(x["h"]), 16, "0")), F.lit(":"), x["pos"].cast("string"))))


def likeness(a: Column, b: Column, keep: int = KEEP) -> Column:
    """0 to 1: of the `keep` smallest hashes of both sketches, the part that is in both at matching places.

    Two places match if some other common anchor is shifted as far; among fewer than 2 K hashes every common anchor counts. Equal sketches are at 1, two empty ones too.
    """

    def of(p):
        a, b = p["a"], p["b"]
        ha, hb = F.transform(a, lambda x: x["h"]), F.transform(b, lambda x: x["h"])
        every = F.slice(F.array_sort(F.array_union(ha, hb)), 1, keep)

        def shifts(common):
            place = lambda s, h: F.get(s, (F.array_position(F.transform(s, lambda x: x["h"]), h) - 1).cast("int"))["pos"]
            return F.array_sort(F.transform(common, lambda h: place(a, h) - place(b, h)))

        common = F.array_intersect(F.array_intersect(every, ha), hb)
        backed = _let(_let(common, shifts), lambda d: F.size(F.filter(d, lambda x, i: (F.size(every) < 2 * K) | F.coalesce(F.get(d, i - 1) == x, F.lit(False)) | F.coalesce(F.get(d, i + 1) == x, F.lit(False)))))
        return F.when(F.size(every) == 0, F.lit(1.0)).when(a == b, F.lit(1.0)).otherwise(backed / F.size(every))

    return _let(F.struct(a.alias("a"), b.alias("b")), of).cast("double")


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with fingerprint (text: hash:place of each anchor) and anchors. Equal texts have equal ones; null and wordless texts have an empty one. Row by row, nothing is shuffled."""
    anchors = sketch(units(F.coalesce(F.col(text_col), F.lit(""))))
    return docs.withColumn("anchors", anchors).withColumn("fingerprint", as_text(F.col("anchors")))


def with_next(docs: DataFrame, id_col: str, tie_col: str, columns: list[str], buckets: int | None = None) -> DataFrame:
    """docs with next: a struct of `columns` of the row that follows in descending order of id_col (null ids last, ties by tie_col); after the last the first.

    Ids are cut into ranges at quantiles. Each range is ordered by itself; the first row of each is sent to the range before it as well, so that
    no range needs another. Only the quantiles and the largest id of each range are collected: one for each range, whatever the rows.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).alias("id"))
    cuts = sorted(set(ids.approxQuantile("id", [i / buckets for i in range(1, buckets)], 0.1 / buckets)))
    place = lambda c: F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < c.cast("double"))), F.lit(0)) if cuts else F.lit(0)
    tops = ids.groupBy(place(F.col("id")).alias("b")).agg(F.max("id").alias("top")).orderBy(F.desc("b")).collect()
    if not tops:
        return docs.withColumn("next", F.lit(None).cast(docs.select(F.struct(*columns)).dtypes[0][1]))
    # the top of each range goes to the range that precedes it in the order; that of the first to the last
    goes = {t.b: tops[i - 1].b for i, t in enumerate(tops)}
    own = place(F.col(id_col))
    top = F.element_at(F.create_map(*(F.lit(x) for t in tops for x in (t.b, -1 if t.top is None else t.top))), F.col("_b"))
    to = F.element_at(F.create_map(*(F.lit(x) for kv in goes.items() for x in kv)), F.col("_b"))
    is_top = F.col(id_col).eqNullSafe(top) if all(t.top is not None for t in tops) else F.coalesce(F.col(id_col), F.lit(-1)) == top
    sent = F.when(is_top, F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy")), F.struct(to.alias("b"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy"))))
    rows = docs.withColumn("_b", own).withColumn("_to", F.explode(sent))
    w = Window.partitionBy("_to.b").orderBy("_to.copy", F.col(id_col).desc_nulls_last(), tie_col)
    return rows.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("not _to.copy").drop("_b", "_to")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n/3) code points replaced by the first as many (or all) of following."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Null texts count as empty. Rows with equal ids follow each other by the hash of their text. Extra columns are ignored. An empty table gives an empty one.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    packed = own.withColumn("anchors", sketch(units(F.col("text")))).select("id", "text", "tie", F.transform("anchors", lambda x: x["h"]).alias("h"), F.transform("anchors", lambda x: x["pos"]).alias("pos"))
    both = with_next(packed, "id", "tie", ["text", "h", "pos"])  # plain arrays: half the bytes of structs in the shuffle
    anchors = lambda h, pos: F.zip_with(h, pos, lambda a, b: F.struct(a.alias("h"), b.alias("pos")))
    both = both.withColumn("anchors", anchors(F.col("h"), F.col("pos"))).withColumn("next_anchors", anchors(F.col("next.h"), F.col("next.pos")))
    both = both.withColumn("edited", edited(F.col("text"), F.col("next.text"))).withColumn("edited_anchors", sketch(units(F.col("edited"))))
    return both.select(
        F.col("id").alias(id_col), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("anchors")).alias("fingerprint"), as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
