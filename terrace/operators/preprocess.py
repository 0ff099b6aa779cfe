"""Median imputation and ordinal codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MISSING = "__NA__"  # fixed value: the category of missing values


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaN of numeric columns replaced by the median of the others; 0 where there are none."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    medians = df.agg(*(F.percentile(x, F.lit(0.5)).alias(c) for c, x in clean.items())).first()
    return df.withColumns({c: F.coalesce(x, F.lit(medians[c] or 0.0)) for c, x in clean.items()})


def ordinal_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the place (from 0) of each category among the sorted distinct ones; null is a category of its own. Distinct categories are ranked, not rows."""
    category = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    codes = df.select(category.alias("_c")).distinct().withColumn(out, (F.row_number().over(Window.orderBy("_c")) - 1).cast("int"))
    return df.withColumn("_c", category).join(codes, "_c").select(*df.columns, out)
