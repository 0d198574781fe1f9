"""Joins that build the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.keys import expect_unique, next_month


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join after checking that the key is unique on both sides."""
    return expect_unique(left, keys).join(expect_unique(right, keys), list(keys))


def lagged_macro(df: DataFrame, macro: DataFrame, columns: Sequence[str], month: str = "month", lag: int = 1) -> DataFrame:
    """Macro values of a month joined to the month ``lag`` later; one row per month, so Spark broadcasts it when it is small."""
    moved = macro.select(next_month(month, lag).alias(month), *columns)
    return df.join(moved, month, "left")


def same_month(df: DataFrame, macro: DataFrame, columns: Sequence[str], month: str = "month") -> DataFrame:
    return df.join(macro.select(month, *columns), month, "left")


def drop_unmatched(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def unmatched_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, and rows with a null in any of the columns."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_unmatched"))


def attach_target(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(target, list(keys), "left")


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of each side and those of both."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    marks = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), key, "full_outer")
    return marks.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"))


def models_wide(long: DataFrame, keys: Sequence[str], models: Sequence[str], value: str = "prediction") -> DataFrame:
    """One prediction column a model, rows that all models have."""
    wide = long.groupBy(*keys).agg(*[F.first(F.when(F.col("model") == m, F.col(value)), ignorenulls=True).alias(m) for m in models])  # one aggregate, where a pivot takes two
    return wide.na.drop(subset=list(models))


def coverage(df: DataFrame, column: str) -> DataFrame:
    """Percent of rows without a value."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), (100 * F.avg(F.col(column).isNull().cast("double"))).alias("pct_missing"))


def attach_with_losses(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Inner join, and one row with the number and percent of left rows it loses."""
    lost = left.join(right, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("n_lost"))
    n = left.agg(F.count(F.lit(1)).alias("n_rows"))
    return left.join(right, list(keys)), n.crossJoin(lost).withColumn("pct_lost", 100 * F.col("n_lost") / F.col("n_rows"))


def common_months(series: DataFrame, name: str = "portfolio", month: str = "month") -> DataFrame:
    """Rows of the months that every series has."""
    n = series.select(name).distinct().agg(F.count(F.lit(1)).alias("__all"))
    full = series.groupBy(month).agg(F.countDistinct(name).alias("__n")).crossJoin(F.broadcast(n)).where("__n = __all").select(month)
    return series.join(full, month, "left_semi")
