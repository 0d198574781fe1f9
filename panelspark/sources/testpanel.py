"""A monthly panel derived from the driver's line items, see FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.keys import month_index
from panelspark.sources.scratch import spread


def panel(spark: SparkSession, sf_dir: str, entity: str = "l_partkey") -> DataFrame:
    """One row per (entity, month); sums are integers, each feature one division."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = lines.select(F.col(entity).cast("long").alias("entity"), F.date_format("l_shipdate", "yyyyMM").alias("month"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    base = spread(lines, "entity").groupBy("entity", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"), cents("l_extendedprice").alias("cents"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax")
    )
    d = lambda c: F.expr(c).cast("double")
    base = base.withColumn("month_idx", month_index("month"))
    return base.select(
        "entity", "month", "month_idx",
        (d("disc - tax") / F.expr("100 * n")).alias("ret"),
        (d("10 + month_idx % 12") / 10000).alias("rf"),
        (d("cents") / 100).alias("cap"),
        (d("n") / F.col("cents")).alias("illiq"),
        F.when((F.col("entity") + F.col("month_idx")) % 7 != 0, d("qty") / F.col("n")).alias("f1"),
        F.when((F.col("entity") + F.col("month_idx")) % 11 != 0, d("cents") / F.col("qty")).alias("f2"),
        (d("disc") / F.col("n")).alias("f3"),
        (d("qty") / F.expr("1000 * n")).alias("pred_a"),
        (d("tax + 2 * disc") / F.expr("1000 * n")).alias("pred_b"),
    )


def panel_sql(entity: str = "l_partkey") -> str:
    """The same panel as a DuckDB subquery."""
    return f"""
 SELECT entity, month, month_idx, CAST(disc - tax AS DOUBLE) / (100 * n) AS ret, CAST(10 + month_idx % 12 AS DOUBLE) / 10000 AS rf,
  CAST(cents AS DOUBLE) / 100 AS cap, CAST(n AS DOUBLE) / cents AS illiq,
  CASE WHEN (entity + month_idx) % 7 = 0 THEN NULL ELSE CAST(qty AS DOUBLE) / n END AS f1,
  CASE WHEN (entity + month_idx) % 11 = 0 THEN NULL ELSE CAST(cents AS DOUBLE) / qty END AS f2,
  CAST(disc AS DOUBLE) / n AS f3, CAST(qty AS DOUBLE) / (1000 * n) AS pred_a, CAST(tax + 2 * disc AS DOUBLE) / (1000 * n) AS pred_b
 FROM (SELECT *, CAST(substring(month,1,4) AS INT)*12 + CAST(substring(month,5,2) AS INT) AS month_idx FROM (
   SELECT CAST({entity} AS BIGINT) AS entity, strftime(l_shipdate,'%Y%m') AS month, CAST(count(*) AS BIGINT) AS n,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS cents,
    CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS BIGINT) AS disc, CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS BIGINT) AS tax
   FROM lineitem GROUP BY 1, 2))"""


def macro(panel_df: DataFrame) -> DataFrame:
    """One row per month: the risk-free rate and monthly sums as macro columns."""
    return panel_df.groupBy("month", "month_idx").agg(F.first("rf").alias("rf"), F.sum(F.round(F.col("cap") * 100).cast("long")).alias("index_level"), F.count(F.lit(1)).alias("n_entities"))


FACTORS = ["mktrf", "smb", "hml", "rmw", "cma", "mom"]


def factors(panel_df: DataFrame) -> DataFrame:
    """Six factor series: monthly means of the return over entity classes."""
    wide = [F.avg(F.when(F.col("entity") % 6 == i, F.col("ret"))).alias(f) for i, f in enumerate(FACTORS)]
    return panel_df.groupBy("month", "month_idx").agg(*wide)


def factors_sql(panel: str = "panel") -> str:
    wide = ", ".join(f"avg(CASE WHEN entity % 6 = {i} THEN ret END) AS {f}" for i, f in enumerate(FACTORS))
    return f"SELECT month, month_idx, {wide} FROM {panel} GROUP BY 1, 2"


def predictions(panel_df: DataFrame) -> DataFrame:
    """Two models' predictions, long: ``model, entity, month, month_idx, y, prediction, cap``."""
    return panel_df.select("entity", "month", "month_idx", (F.col("ret") - F.col("rf")).alias("y"), "cap", F.expr("stack(2, 'a', pred_a, 'b', pred_b) as (model, prediction)"))


def predictions_sql(panel: str = "panel") -> str:
    return f"SELECT entity, month, month_idx, ret - rf AS y, cap, 'a' AS model, pred_a AS prediction FROM {panel} UNION ALL SELECT entity, month, month_idx, ret - rf, cap, 'b', pred_b FROM {panel}"
