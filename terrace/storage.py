"""Written tables in the folder that driver and executors share, and prefix sums over ordered ranges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="terrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that later steps neither recompute it nor need the executor that made it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, path = df.sparkSession, df._staged_path
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def range_bucket(df: DataFrame, column: str, buckets: int) -> Column:
    """The place of a numeric column among about equal ranges of its values (NaN and null: the last and the first range), ascending with it."""
    cuts = sorted(set(df.where(~F.isnan(F.col(column).cast("double"))).approxQuantile(column, [i / buckets for i in range(1, buckets)], 0.2 / buckets))) if buckets > 1 else []
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column).cast("double"))), F.lit(0))


def bucket_offsets(df: DataFrame, bucket: str, sums: dict[str, str]) -> DataFrame:
    """For each bucket and each name of `sums` the sum of its column over all smaller buckets; one row for each bucket is sorted, whatever the rows."""
    per = df.groupBy(bucket).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    w = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(bucket, *(F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)).alias(n) for n in sums))


def with_row_id(df: DataFrame, keys: list[str] | None = None, name: str = "row_id") -> DataFrame:
    """df and a gapless position from 0, ascending in `keys` (unique together); without keys, in the order of df's partitions.

    Rows are range-partitioned and sorted once and written; positions are a partition's offset plus the place in it, so no task holds all rows.
    """
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    placed = staged(spread.withColumn("_at", F.monotonically_increasing_id()), "rows")
    part = F.shiftrightunsigned("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))  # one row for each partition
    out = placed.withColumn("_part", part).join(starts, "_part")
    return out.select(*(F.col(c) for c in df.columns), (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
