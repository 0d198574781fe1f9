"""Month keys, missing values and expectations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def month_index(month: Column | str) -> Column:
    """``AAAAMM`` text to a month number that lags and ranges can use."""
    m = F.col(month) if isinstance(month, str) else month
    return (F.substring(m, 1, 4).cast("int") * 12 + F.substring(m, 5, 2).cast("int")).cast("int")


def month_text(index: Column | str) -> Column:
    """The inverse of :func:`month_index`."""
    i = (F.col(index) if isinstance(index, str) else index) - 1
    return F.format_string("%04d%02d", F.floor(i / 12), (i % 12) + 1)


def next_month(month: Column | str, by: int = 1) -> Column:
    m = F.col(month) if isinstance(month, str) else month
    return F.date_format(F.add_months(F.to_date(m, "yyyyMM"), by), "yyyyMM")


def year_of(date: Column | str) -> Column:
    """Year of an integer date yyyymmdd."""
    d = F.col(date) if isinstance(date, str) else date
    return F.floor(d / 10000).cast("int")


def decade_of(year: Column | str) -> Column:
    y = F.col(year) if isinstance(year, str) else year
    return (F.floor(y / 10) * 10).cast("int")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark tells NaN from null; the panel has one kind of missing value, null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, with no negative zero."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in doubles})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, and rows beyond the first of their key."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key in an explicit order."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def expect_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The frame itself; raises if a key repeats.  One small aggregate runs at once."""
    found = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if found:
        raise ValueError(f"keys {list(keys)} repeat, for instance {found[0].asDict()}")
    return df


def expect_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    if bad := {c: counts[c] for c in columns if counts[c]}:
        raise ValueError(f"nulls where none may be: {bad}")
    return df


def not_empty(df: DataFrame, message: str) -> DataFrame:
    """The frame itself; a job that reads it fails with ``message`` if it has no row.

    Nothing runs when the plan is built: a count of the rows stands beside them
    and reaches them as no row at all.  Use it on small results, as the count
    may repeat what lies between the last shuffle and the frame.
    """
    none = F.raise_error(F.concat(F.lit(f"{message}: "), F.col("__n").cast("string"), F.lit(" rows"))).cast("boolean")
    guard = df.agg(F.count(F.lit(1)).alias("__n")).where(F.when(F.col("__n") == 0, none).otherwise(False))
    return df.unionByName(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))
