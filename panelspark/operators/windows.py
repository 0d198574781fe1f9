"""Walk-forward windows: a small table of (window, block, month), joined to the panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODES = ("expanding", "rolling")


@dataclass(frozen=True)
class WindowPlan:
    """Years of training, validation and test; validation may shrink by ``shrink`` years a window from window ``shrink_from`` on, down to ``floor``."""

    mode: str = "rolling"
    train_years: int = 3
    validation_years: int = 2
    test_years: int = 1
    shrink: int = 0
    shrink_from: int = 2
    floor: int = 1

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.floor < 1 or min(self.train_years, self.validation_years, self.test_years) < 1:
            raise ValueError("blocks need a year at least")

    def validation(self, number: Column) -> Column:
        """Validation years of a window number (from 1)."""
        shrunk = F.lit(self.validation_years) - self.shrink * F.greatest(number - self.shrink_from + 1, F.lit(0))
        return F.greatest(shrunk, F.lit(min(self.floor, self.validation_years)))


def windows(months: DataFrame, plan: WindowPlan) -> DataFrame:
    """``window_id, block, month, month_idx, test_year`` from the panel's months.

    The first test block starts after the first year plus training and validation
    years; test blocks follow each other.  Validation lies right before the test,
    training before that: ``train_years`` long, or from the first month on.
    Windows with an empty block are left out; months too few for any window fail
    the job.  ``months`` is a handful of rows.
    """
    months = months.select("month", "month_idx").distinct().withColumn("year", F.substring("month", 1, 4).cast("int"))
    span = months.agg(F.min("year").alias("first"), F.max("year").alias("last"))
    start = F.col("first") + plan.train_years + plan.validation_years
    none = F.raise_error(F.lit("the panel's years are too few for a window")).cast("boolean")
    tests = span.where(F.when(start > F.col("last"), none).otherwise(True)).where("first is not null").select("first", F.posexplode(F.sequence(start, F.col("last"), F.lit(plan.test_years))).alias("pos", "test_year"))
    tests = tests.withColumn("window_id", F.col("pos") + 1).withColumn("v", plan.validation(F.col("pos") + 1))
    low = F.col("test_year") - F.col("v")
    oldest = F.col("first") if plan.mode == "expanding" else low - plan.train_years
    block = F.when((F.col("year") >= oldest) & (F.col("year") < low), "train").when((F.col("year") >= low) & (F.col("year") < F.col("test_year")), "validation").when((F.col("year") >= F.col("test_year")) & (F.col("year") < F.col("test_year") + plan.test_years), "test")
    rows = months.crossJoin(F.broadcast(tests)).withColumn("block", block).where("block is not null")
    full = rows.groupBy("window_id").agg(F.countDistinct("block").alias("n")).where("n = 3").select("window_id")
    return rows.join(F.broadcast(full), "window_id", "left_semi").select("window_id", "block", "month", "month_idx", "test_year")


def summarise(table: DataFrame) -> DataFrame:
    return table.groupBy("window_id", "block").agg(F.min("month").alias("start"), F.max("month").alias("end"), F.count(F.lit(1)).alias("n_months"), F.countDistinct(F.substring("month", 1, 4)).alias("n_years"))


def embargo(table: DataFrame, horizon: int) -> DataFrame:
    """Without the last ``horizon`` months of training and validation, whose targets reach into the next block.

    A block that would be left without a month fails the job.
    """
    w = Window.partitionBy("window_id", "block")
    empty = F.raise_error(F.concat(F.lit("the embargo empties block "), "block", F.lit(" of window "), F.col("window_id").cast("string"))).cast("boolean")
    rows = table.withColumn("__r", F.row_number().over(w.orderBy(F.desc("month_idx")))).withColumn("__n", F.count(F.lit(1)).over(w))
    return rows.where(F.when(F.col("block") == "test", True).when(F.col("__n") <= horizon, empty).otherwise(F.col("__r") > horizon)).drop("__r", "__n")


def assign(panel: DataFrame, table: DataFrame) -> DataFrame:
    """The panel's rows once for each window and block they belong to."""
    return panel.join(F.broadcast(table.select("window_id", "block", "month")), "month")


def train_statistics(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means and deviations of the training rows of each window."""
    return rows.where("block = 'train'").groupBy("window_id").agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def restrict_start(panel: DataFrame, year: int) -> DataFrame:
    """The panel from a year on; a panel that ends before fails the job."""
    of = F.substring("month", 1, 4).cast("int")
    last = F.broadcast(panel.agg(F.max(of).alias("__last")))
    none = F.raise_error(F.lit(f"the panel has no month from {year} on")).cast("boolean")
    return panel.crossJoin(last).where(F.when(F.col("__last") < year, none).otherwise(of >= year)).drop("__last")


def r2_zero(y: str = "y", prediction: str = "prediction") -> Column:
    """1 - sum of squared errors over the sum of squares: the benchmark forecasts 0.

    Null where the target is 0 throughout.
    """
    return 1 - F.try_divide(F.sum((F.col(y) - F.col(prediction)) ** 2), F.sum(F.col(y) ** 2))


def block_table(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """R2 of each block side by side, and how far validation and test fall behind training and validation."""
    blocks = ["train", "validation", "test"]
    one = r2_table(rows, [*by, "block"]).groupBy(*by).pivot("block", blocks).agg(F.first("r2"))
    return one.withColumn("gap_validation", F.col("train") - F.col("validation")).withColumn("gap_test", F.col("validation") - F.col("test"))


def r2_table(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pooled R2 of each group: sums first, then one ratio."""
    return rows.groupBy(*by).agg(r2_zero().alias("r2"), F.count(F.lit(1)).alias("n"))
