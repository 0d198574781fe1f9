"""Forward compounded excess return over H months, with delistings and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLOOR = -0.999999
POLICIES = ("risk_free", "zero")


def restrict_to_macro(returns: DataFrame, macro: DataFrame) -> DataFrame:
    """Returns inside the months that the macro table spans; returns of which none lies inside fail the job."""
    span = macro.agg(F.min("month_idx").alias("__a"), F.max("month_idx").alias("__b"))
    inside = F.col("month_idx").between(F.col("__a"), F.col("__b"))
    some = returns.crossJoin(F.broadcast(span)).agg(F.count_if(~F.coalesce(inside, F.lit(False))).alias("__out"), F.count_if(inside).alias("__in"))
    none = F.raise_error(F.concat(F.lit("no return lies in the macro table's months, outside: "), F.col("__out").cast("string"))).cast("boolean")
    kept = F.when((F.col("__in") == 0) & (F.col("__out") > 0), none).otherwise(inside)
    return returns.crossJoin(F.broadcast(span)).crossJoin(F.broadcast(some)).where(kept).drop("__a", "__b", "__in", "__out")


def coverage(returns: DataFrame, macro: DataFrame) -> DataFrame:
    """One row: returns in all, before, inside and after the macro table's months."""
    span = macro.agg(F.min("month_idx").alias("a"), F.max("month_idx").alias("b"))
    m = F.col("month_idx")
    return returns.crossJoin(F.broadcast(span)).agg(F.count(F.lit(1)).alias("n_returns"), F.count_if(m < F.col("a")).alias("n_before"), F.count_if(m.between(F.col("a"), F.col("b"))).alias("n_inside"), F.count_if(m > F.col("b")).alias("n_after"))


def monthly_grid(returns: DataFrame, horizon: int) -> DataFrame:
    """Every month of every entity from its first to its last, and ``horizon`` more for those that end early.

    Columns ``entity, month_idx, ret, extension, status, panel_end``.  Inner gaps
    have a null return.  A grid row exists for each month of one entity only, so
    the work is that of the entity-months.
    """
    end = returns.agg(F.max("month_idx").alias("panel_end"))
    span = returns.groupBy("entity").agg(F.min("month_idx").alias("a"), F.max("month_idx").alias("b")).crossJoin(F.broadcast(end))
    status = F.when(F.col("b") < F.col("panel_end"), F.lit("delisted")).otherwise(F.lit("listed_at_end"))
    grid = span.select("entity", "panel_end", "b", status.alias("status"), F.explode(F.sequence("a", F.least(F.col("b") + horizon, F.col("panel_end")))).alias("month_idx"))
    rows = returns.select("entity", "month_idx", "ret")
    return grid.join(rows, ["entity", "month_idx"], "left").select("entity", "month_idx", "ret", (F.col("month_idx") > F.col("b")).alias("extension"), "status", "panel_end")


def forward_excess(returns: DataFrame, macro: DataFrame, horizon: int, policy: str = "risk_free") -> DataFrame:
    """``entity, month_idx, target, n_observed, status`` for every return row.

    ``macro``: ``month_idx, rf``.  The target of month t compounds months t+1 to
    t+H of the return and of the rate, and subtracts.  It is null if a month is
    missing or if t+H lies behind the panel's end.  In extension months the return
    is the rate, or 0.  A month of the grid without a rate fails the job, be it one
    with returns, a gap or an extension.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    grid = monthly_grid(restrict_to_macro(returns, macro), horizon).join(macro.select("month_idx", "rf"), "month_idx", "left")
    grid = grid.withColumn("rf", F.when(F.col("rf").isNull(), F.raise_error(F.concat(F.lit("no rate for month "), F.col("month_idx").cast("string"))).cast("double")).otherwise(F.col("rf")))
    r = F.when(F.col("extension"), F.col("rf") if policy == "risk_free" else F.lit(0.0)).otherwise(F.col("ret"))
    grid = grid.withColumn("r", F.when(r.isNotNull(), F.greatest(r, F.lit(FLOOR))))  # greatest alone would pass over a null
    w = Window.partitionBy("entity").orderBy("month_idx").rangeBetween(1, horizon)
    gone = lambda c: F.expm1(F.sum(F.log1p(c)).over(w))
    full = (F.count("r").over(w) == horizon) & (F.count("rf").over(w) == horizon) & (F.col("month_idx") + horizon <= F.col("panel_end"))
    out = grid.select(
        "entity", "month_idx", "extension", "status", "ret",
        F.when(full, gone("r") - gone("rf")).alias("target"),
        F.coalesce(F.sum(F.when(~F.col("extension"), 1).otherwise(0)).over(w), F.lit(0)).cast("long").alias("n_observed"),
    )
    return out.where("not extension and ret is not null").select("entity", "month_idx", "target", "n_observed", "status")


def check_rates(returns: DataFrame, macro: DataFrame) -> DataFrame:
    """Months of the returns without a rate; there should be none."""
    return returns.select("month_idx").distinct().join(macro.where("rf is not null").select("month_idx"), "month_idx", "left_anti")


def total_losses(returns: DataFrame) -> DataFrame:
    """Rows whose return is -1 or lower."""
    return returns.agg(F.count_if(F.col("ret") <= -1).alias("n_total_losses"))


def diagnose(returns: DataFrame, macro: DataFrame, horizon: int, policy: str = "risk_free") -> DataFrame:
    """One row: valid targets, rows lost to gaps and to the panel's end, entities with gaps, delisted entities, total losses."""
    rows = forward_excess(returns, macro, horizon, policy).crossJoin(F.broadcast(returns.agg(F.max("month_idx").alias("panel_end"))))
    late = F.col("month_idx") + horizon > F.col("panel_end")
    one = rows.agg(
        F.count("target").alias("n_valid"),
        F.count_if(F.col("target").isNull() & ~late).alias("n_lost_gap"),
        F.count_if(F.col("target").isNull() & late).alias("n_lost_end"),
    )
    span = returns.groupBy("entity").agg((F.max("month_idx") - F.min("month_idx") + 1 > F.count(F.lit(1))).alias("gap"), F.max("month_idx").alias("b")).crossJoin(F.broadcast(returns.agg(F.max("month_idx").alias("panel_end"))))
    ents = span.agg(F.count_if("gap").alias("n_entities_gap"), F.count_if(F.col("b") < F.col("panel_end")).alias("n_delisted"))
    return one.crossJoin(ents).crossJoin(total_losses(returns))


def prepare_panel(panel: DataFrame, target: str, horizon: int) -> DataFrame:
    """Rows with a target; one-month panels have no missing targets to drop."""
    if target not in panel.columns:
        raise ValueError(f"the panel has no column {target}")
    return panel.na.drop(subset=[target]) if horizon > 1 else panel
