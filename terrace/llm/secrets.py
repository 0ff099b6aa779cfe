"""Secret scans: base patterns, and weak credential parts that count only where complementary parts co-occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import without

# Kinds in their order, with pattern, the group whose length counts, and its least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "user": (r"""(?i)(?<![a-z0-9])(user(?:_?name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 2, 3),
    "key": (r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    "endpoint": (r"""(?i)(?:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+""", 0, 8),
}
BASE = ("assign", "access", "hex")
SCOPE = 200
"""Code points between two parts that still belong to one scope."""


def candidates(text):
    """An array of (kind's place, pos, gap, len, ok) of all matches of all kinds: gap is the length of the text since the kind's last match.

    `access` and `hex` ask for their least length in the pattern: a run that is too short can't hold a longer match, so this finds the
    same matches as dropping short ones, without listing every letter from a to f. Splitting and extracting by one pattern see the same matches.
    """

    def of(i, pattern, group, least):
        p = F.lit(pattern)
        hits = F.regexp_extract_all(text, p, F.lit(0))
        counts = F.regexp_extract_all(text, p, F.lit(group)) if group else hits
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), counts.alias("count"))
        rows = F.transform(
            F.filter(zipped, lambda x: x["hit"].isNotNull()),
            lambda x, pos: F.struct(F.lit(i).alias("kind"), pos.alias("pos"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"), (F.length(x["count"]) >= least).alias("ok")),
        )
        return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,ok:boolean>>"))

    return F.concat(*(of(i, *k) for i, k in enumerate(KINDS.values())))


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """The `keep` columns (all, if None) and spans: an array of (start, kind, end, base), by start, then kind; code points, end exclusive.

    Base spans are the leftmost non-overlapping matches of each base kind that are long enough. The other kinds are weak parts: `user`
    (identifier), `key` (secret) and `endpoint`. Those that no base span holds are reported only with complementary parts
    within `scope` code points: a user with a base secret; a key with an access identifier, or with a user and an endpoint; an endpoint
    with an identifier and a secret. This interval join takes the nearest part of each role before and after, in two sorted passes over a
    document's own matches, so a document with many parts makes no pairs.

    One row for each row of docs, repeated rows too; null and empty texts have no spans. A row's kept columns travel once, with its
    first match. Extra columns with any name are kept apart in a struct; one named spans gives way.
    """
    keep = without(docs.columns if keep is None else keep, "spans")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(c) for c in keep)).alias("kept"), candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("c"))
    rows = rows.select("rid", F.posexplode_outer("c").alias("nth", "c"), "kept")
    rows = rows.select("rid", F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("kept")).alias("kept"), F.col("c.kind").alias("kind"), "c.pos", "c.gap", "c.len", "c.ok")
    parts = rows.repartition("rid")
    before = Window.partitionBy("rid", "kind").orderBy("pos")
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before).cast("int")).withColumn("start", F.col("end") - F.col("len"))
    kind = {k: i for i, k in enumerate(KINDS)}
    good = F.coalesce("ok", F.lit(False))
    roles = {"base": F.col("kind") < len(BASE), "access": F.col("kind") == kind["access"], "secret": F.col("kind").isin(kind["assign"], kind["hex"]), "user": F.col("kind") == kind["user"], "endpoint": F.col("kind") == kind["endpoint"]}
    ahead = Window.partitionBy("rid").orderBy(F.col("start").asc_nulls_last(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("rid").orderBy(F.col("start").desc_nulls_first(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    for r, is_role in roles.items():
        parts = parts.withColumn(f"to_{r}", F.max(F.when(good & is_role, F.col("end"))).over(ahead))
    for r, is_role in roles.items():
        if r != "base":
            parts = parts.withColumn(f"from_{r}", F.min(F.when(good & is_role, F.col("start"))).over(behind))

    def near(r: str):
        return F.coalesce(F.col("start") - F.col(f"to_{r}") <= scope, F.lit(False)) | F.coalesce(F.col(f"from_{r}") - F.col("end") <= scope, F.lit(False))

    held = F.coalesce(F.col("to_base") >= F.col("end"), F.lit(False))
    linked = (
        F.when(roles["base"], F.lit(True))
        .when(held, F.lit(False))
        .when(F.col("kind") == kind["user"], near("secret"))
        .when(F.col("kind") == kind["key"], near("access") | (near("user") & near("endpoint")))
        .otherwise((near("access") | near("user")) & near("secret"))
    )
    span = F.when(good & linked, F.struct("start", "kind", "end"))
    out = parts.groupBy("rid").agg(F.max_by("kept", F.col("kept").isNotNull()).alias("kept"), F.array_sort(F.collect_list(span)).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end"), (s["kind"] < len(BASE)).alias("base")))
    return out.select(*(F.col("kept").getField(c).alias(c) for c in keep), spans.alias("spans"))


def spans_text(spans):
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(scanned: DataFrame, text_col: str = "text", spans_col: str = "spans", mask: str = "[secret]") -> DataFrame:
    """The rows with each stretch that spans cover replaced by `mask`; overlapping or touching spans make one stretch. Null texts stay null."""
    text = F.col(text_col)

    def step(acc, s):
        fresh = s["start"] > acc["at"]
        add = F.when(fresh | (acc["at"] == 0) & (s["start"] == 0) & (F.size(acc["out"]) == 0), F.array(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(acc["out"], add).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate(F.col(spans_col), zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return scanned.withColumn(text_col, F.when(F.size(spans_col) > 0, clean).otherwise(text)).drop(spans_col)


def digest(spans_col: str = "spans") -> list:
    spans = F.col(spans_col)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return [*map(count, BASE), F.sha2(spans_text(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"), spans_text(spans).alias("spans")]
