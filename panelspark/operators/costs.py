"""Leg weights, drift, turnover, costs and break-even thresholds.

Weights are long tables ``leg, month, month_idx, entity, w`` (``by`` names more
keys); the previous month of a leg is the previous month that the leg has, not
the calendar's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.operators.portfolios import measures
from panelspark.sources.scratch import parts, spread, written


def leg_weights(df: DataFrame, member: Column, leg: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Weights of the member rows, equal or by a positive column; each month sums to 1."""
    rows = df.where(member)
    raw = F.lit(1.0) if weight is None else F.col(weight)
    if weight is not None:
        rows = rows.where(F.col(weight) > 0)
    rows = rows.select(*by, F.lit(leg).alias("leg"), "month", "month_idx", "entity", raw.alias("__w"))
    whole = F.broadcast(rows.groupBy(*by, "month").agg(F.sum("__w").alias("__s")))
    return rows.join(whole, [*by, "month"]).select(*by, "leg", "month", "month_idx", "entity", (F.col("__w") / F.col("__s")).alias("w"))


def entity_returns(df: DataFrame, ret: str = "ret") -> DataFrame:
    """Mean total return of each (month, entity)."""
    return df.groupBy("month_idx", "entity").agg(F.avg(ret).alias("r"))


def with_returns(weights: DataFrame, returns: DataFrame | None) -> DataFrame:
    """Weights with ``r``, their month's return; None where they have it."""
    if returns is None:
        return weights
    n = max(parts(weights), parts(returns))
    return spread(weights, "month_idx", "entity", n=n).join(spread(returns, "month_idx", "entity", n=n).hint("merge"), ["month_idx", "entity"], "left")


def drifted(weights: DataFrame, returns: DataFrame | None, by: Sequence[str] = ("leg",)) -> DataFrame:
    """Weights after their month's returns, as shares again; a missing return is 0, and shares of a leg that lost all are null."""
    grown = with_returns(weights, returns).withColumn("g", F.col("w") * (1 + F.coalesce("r", F.lit(0.0))))
    whole = F.broadcast(grown.groupBy(*by, "month_idx").agg(F.sum("g").alias("__s")))
    return grown.join(whole, [*by, "month_idx"]).withColumn("drifted", F.try_divide("g", "__s")).drop("g", "r", "__s")


def turnover(weights: DataFrame, returns: DataFrame | None, by: Sequence[str] = ("leg",)) -> DataFrame:
    """``by, month, turnover, entries_exits, rebalancing``; the last two make the first.

    Each weight is compared with the drifted weight of the leg's previous month,
    both for names on one side only.  The first month is all entries.
    """
    months = weights.select(*by, "month", "month_idx").distinct()
    months = months.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("month_idx")))
    places = F.broadcast(months.select(*by, "month_idx", "position"))
    now = weights.join(places, [*by, "month_idx"]).select(*by, "position", "entity", "w")
    before = drifted(weights, returns, by).join(places, [*by, "month_idx"]).select(*by, (F.col("position") + 1).alias("position"), "entity", "drifted")
    keys, n = [*by, "position", "entity"], parts(weights)
    both = spread(now, *keys, n=n).join(spread(before, *keys, n=n), keys, "full_outer")
    gap = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("drifted", F.lit(0.0)))
    common = (F.coalesce("w", F.lit(0.0)) > 0) & (F.coalesce("drifted", F.lit(0.0)) > 0)
    sums = both.groupBy(*by, "position").agg(F.sum(gap).alias("turnover"), F.sum(F.when(common, F.lit(0.0)).otherwise(gap)).alias("entries_exits"), F.sum(F.when(common, gap).otherwise(F.lit(0.0))).alias("rebalancing"))
    return sums.join(months, [*by, "position"]).select(*by, "month", "month_idx", "turnover", "entries_exits", "rebalancing")


def buffered(df: DataFrame, enter: int, stay: int, side: str = "high", by: Sequence[str] = ()) -> DataFrame:
    """``held``: in since a month at decile ``enter``, with every month since at ``stay`` and present.

    A row's run breaks where the entity missed the previous month of the data, or
    where the decile does not let it stay; it is held from the first entry in the
    run on.  ``side`` ``low`` mirrors the comparisons.
    """
    if side not in ("high", "low"):
        raise ValueError("side must be high or low")
    at = lambda bound: F.coalesce(F.col("decile") >= bound if side == "high" else F.col("decile") <= bound, F.lit(False))
    months = df.select("month_idx").distinct().withColumn("__p", F.row_number().over(Window.orderBy("month_idx")))
    rows = df.join(F.broadcast(months), "month_idx").withColumn("__in", at(enter)).withColumn("__on", at(stay))
    line = Window.partitionBy(*by, "entity").orderBy("__p")
    gap = F.coalesce(F.col("__p") - F.lag("__p").over(line) > 1, F.lit(True))
    rows = rows.withColumn("__run", F.sum(F.when(gap | ~F.col("__on"), 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "entity", "__run").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("held", F.max("__in").over(inside)).drop("__p", "__in", "__on", "__run")


def leg_returns(weights: DataFrame, returns: DataFrame | None, by: Sequence[str] = ("leg",)) -> DataFrame:
    """Sum of weight times the same month's return; a missing return is 0."""
    rows = with_returns(weights, returns)
    return rows.groupBy(*by, "month", "month_idx").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("ret"))


def monthly_costs(turnovers: DataFrame, trade_bps: float, borrow_bps: float = 0.0, exposure: float = 1.0, skip_first: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """``turnover, trade_cost, borrow_cost, cost`` of each month, legs summed.

    Skipping the first month removes its row, so it bears neither cost.
    """
    total = turnovers.groupBy(*by, "month", "month_idx").agg(F.sum("turnover").alias("turnover"))
    if skip_first:
        first = total.groupBy(*by).agg(F.min("month_idx").alias("__f"))
        total = (total.join(first, list(by)) if by else total.crossJoin(F.broadcast(first))).where("month_idx > __f").drop("__f")
    out = total.withColumn("trade_cost", F.col("turnover") * F.lit(trade_bps / 10_000)).withColumn("borrow_cost", F.lit(borrow_bps / 10_000 / 12 * exposure))
    return out.withColumn("cost", F.col("trade_cost") + F.col("borrow_cost"))


def net_returns(gross: DataFrame, costs: DataFrame, keys: Sequence[str] = ("month",)) -> DataFrame:
    """Gross less cost of the same month; months without a cost row cost 0."""
    return gross.join(costs.select(*keys, "cost"), list(keys), "left").withColumn("net", F.col("ret") - F.coalesce("cost", F.lit(0.0)))


def break_even(rows: DataFrame, borrow_bps: float = 0.0, exposure: float = 1.0, t: float = 1.96, most_bps: float = 500.0, by: Sequence[str] = ()) -> DataFrame:
    """Costs in basis points at which the mean is 0, and at which its t falls to ``t``.

    ``rows``: ``ret`` (gross) and ``turnover`` of each month.  The t statistic as
    a function of the cost c is (m - c q) / sqrt((v - 2 c k + c^2 s) / n); where it
    equals ``t`` is the smaller root of a quadratic.  0 if it is below ``t``
    without costs, infinity if above it at ``most_bps``.
    """
    rows = rows.where("ret is not null and turnover is not null")
    borrow = borrow_bps / 10_000 / 12 * exposure
    one = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("g"), F.avg("turnover").alias("q"), F.var_samp("ret").alias("v"), F.var_samp("turnover").alias("s"), F.covar_samp("ret", "turnover").alias("k"))
    m = F.col("g") - borrow
    # null for a net return that never varies, which counts as not significant
    stat = lambda c: F.try_divide(m - c * F.col("q"), F.sqrt(F.greatest(F.col("v") - 2 * c * F.col("k") + c * c * F.col("s"), F.lit(0.0)) / F.col("n")))
    a = F.col("q") ** 2 - t * t * F.col("s") / F.col("n")
    b = -2 * m * F.col("q") + 2 * t * t * F.col("k") / F.col("n")
    c = m**2 - t * t * F.col("v") / F.col("n")
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    roots = F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a)
    low, high = F.least(*roots), F.greatest(*roots)
    found = F.when(low >= 0, low).otherwise(high)
    top = most_bps / 10_000
    significant = F.when(F.col("n") < 3, F.lit(None)).when(F.coalesce(stat(F.lit(0.0)), F.lit(0.0)) < t, F.lit(0.0)).when(stat(F.lit(top)) > t, F.lit(float("inf"))).otherwise(found * 10_000)
    zero = F.when((F.col("n") >= 2) & (F.col("q") > 0), m / F.col("q") * 10_000)
    return one.select(*by, "n", zero.alias("zero_mean_bps"), significant.alias("significance_bps"))


def margins(table: DataFrame, assumed_bps: float) -> DataFrame:
    """What both thresholds of :func:`break_even` leave above an assumed cost."""
    return table.withColumn("margin_bps", F.col("zero_mean_bps") - assumed_bps).withColumn("significance_margin_bps", F.col("significance_bps") - assumed_bps)


def drags(rows: DataFrame, by: Sequence[str] = (), periods: int = 12) -> DataFrame:
    """Yearly gross and net mean, what trading and borrowing take a year, and their share of the gross mean (null where it is 0).

    ``rows``: those of :func:`long_short_with_costs`; a month without a cost row costs 0.
    """
    mean = lambda c: periods * F.avg(F.coalesce(c, F.lit(0.0)))
    one = rows.where("ret is not null").groupBy(*by).agg(mean(F.col("ret")).alias("gross_annual"), mean(F.col("net")).alias("net_annual"), mean(F.col("trade_cost")).alias("trade_drag_annual"), mean(F.col("borrow_cost")).alias("borrow_drag_annual"))
    return one.withColumn("drag_ratio", F.try_divide(F.col("trade_drag_annual") + F.col("borrow_drag_annual"), "gross_annual"))


def sensitivity(rows: DataFrame, grid: Sequence[float], borrow_bps: float = 0.0, exposure: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Measures of the net return for each cost of a grid, all in one job."""
    costs = rows.sparkSession.createDataFrame([(float(g),) for g in grid], "cost_bps double")
    each = rows.crossJoin(F.broadcast(costs))
    net = each.withColumn("ret", F.col("ret") - F.col("turnover") * F.col("cost_bps") / 10_000 - F.lit(borrow_bps / 10_000 / 12 * exposure))
    return measures(net, [*by, "cost_bps"]).select(*by, "cost_bps", "mean_annual", "volatility_annual", "sharpe", "t_stat")


def turnover_summary(turnovers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, yearly sum, and months of holding: one over a quarter of the mean, null without turnover."""
    return turnovers.groupBy(*by).agg(F.avg("turnover").alias("mean_turnover"), (F.avg("turnover") * 12).alias("annual_turnover"), F.try_divide(F.lit(4.0), F.avg("turnover")).alias("holding_months"), F.count("turnover").alias("n_months"))


def long_short_with_costs(df: DataFrame, trade_bps: float, borrow_bps: float = 0.0, n: int = 10, weight: str | None = None, ret: str = "ret", by: Sequence[str] = (), returns: DataFrame | None = None) -> DataFrame:
    """Legs, gross return, turnover, costs and net return of a long-short on ``decile``.

    ``by`` names portfolios (models, weightings) that share the job: every shuffle
    is keyed by them, and the month's returns are read once for all.  ``returns``
    (``month_idx, entity, r``) saves averaging them over the portfolios' rows.  The
    legs with their returns are written when this is called.
    """
    keys, legs_by = [*by, "month"], [*by, "leg"]
    legs = leg_weights(df, F.col("decile") == n, "long", weight, by).unionByName(leg_weights(df, F.col("decile") == 1, "short", weight, by))
    legs = written(with_returns(legs, entity_returns(df, ret) if returns is None else returns), "legs")
    per_leg = leg_returns(legs.select(*legs_by, "month", "month_idx", "w", "r"), None, legs_by)
    side = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("ret")))
    gross = per_leg.groupBy(*keys, "month_idx").agg((side("long") - side("short")).alias("ret")).where("ret is not null")
    costs = monthly_costs(turnover(legs, None, legs_by), trade_bps, borrow_bps, by=by)
    moved = costs.select(*keys, "turnover", "trade_cost", "borrow_cost", "cost")
    return gross.join(moved, keys, "left").withColumn("net", F.col("ret") - F.coalesce("cost", F.lit(0.0)))


def weightings(df: DataFrame, columns: Mapping[str, str | None], by: str = "weighting", weight: str = "weight") -> DataFrame:
    """The rows once for each named weighting, with its weight: a column's value, or 1 for None."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias(by), (F.lit(1.0) if c is None else F.col(c).cast("double")).alias(weight)) for n, c in columns.items()]))
    return df.withColumn("__w", each).select(*df.columns, "__w.*")
