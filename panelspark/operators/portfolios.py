"""Portfolios from signals: deciles, constructions, measures, rank correlations."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions.keys import not_empty
from panelspark.operators.xsection import average_ranks, correlation, deciles, group_quantiles, top_fraction
from panelspark.sources.scratch import parts, spread, written


def with_decile(df: DataFrame, signal: str, n: int = 10, by: Sequence[str] = ("month",), tie: str = "entity") -> DataFrame:
    return deciles(df, signal, n, by, tie)


def decile_returns(df: DataFrame, target: str, by: Sequence[str] = ("month",), weight: str | None = None) -> DataFrame:
    """Mean realised target of each (cross-section, decile); weighted if a weight is given.

    Weighted rows need a target and a positive weight; a job without any such row fails.
    """
    df = df.where(F.col("decile").isNotNull())
    if weight is None:
        return df.groupBy(*by, "decile").agg(F.avg(target).alias("ret"))
    df = df.where(F.col(target).isNotNull() & (F.col(weight) > 0))
    out = df.groupBy(*by, "decile").agg((F.sum(F.col(weight) * F.col(target)) / F.sum(weight)).alias("ret"))
    return not_empty(out, f"no row has a target and a positive {weight}")


def long_short(deciles: DataFrame, n: int = 10, by: Sequence[str] = ("month",)) -> DataFrame:
    """Top decile minus decile 1."""
    leg = lambda d: F.max(F.when(F.col("decile") == d, F.col("ret")))
    return deciles.groupBy(*by).agg((leg(n) - leg(1)).alias("ret")).where("ret is not null")


def decile_profile(deciles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over months of each decile's return."""
    return deciles.groupBy(*by, "decile").agg(F.avg("ret").alias("mean_ret"), F.count("ret").alias("n_months"))


def decile_sizes(df: DataFrame, by: Sequence[str] = ("month",)) -> DataFrame:
    """Mean number of entities of each decile over months."""
    counts = df.where(F.col("decile").isNotNull()).groupBy(*by, "decile").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("decile").agg(F.avg("n").alias("mean_entities"))


def long_only(df: DataFrame, signal: str, target: str, share: float, by: Sequence[str] = ("month",), weight: str | None = None, tie: str = "entity") -> DataFrame:
    """Return of the top fraction, equally or otherwise weighted; a job in which no row is chosen fails."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    chosen = top_fraction(df, signal, target, share, by, tie)
    if weight is None:
        return not_empty(chosen.groupBy(*by).agg(F.avg(target).alias("ret")), f"every cross-section has fewer rows than a share of {share} needs")
    chosen = chosen.where(F.col(weight) > 0)
    return not_empty(chosen.groupBy(*by).agg((F.sum(F.col(weight) * F.col(target)) / F.sum(weight)).alias("ret")), f"no row of the top {share} has a positive {weight}")


def monthly_rebalance(df: DataFrame, signal: str, monthly: str, n: int = 10, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Long-short return that holds for a month what a signal of any horizon ranks; ``by`` names portfolios that share the job."""
    keys = [*by, "month"]
    return long_short(decile_returns(with_decile(df, signal, n, keys), monthly, keys, weight), n, keys)


def cohort_positions(df: DataFrame, signal: str, monthly: str, horizon: int, n: int = 10, deciles: Sequence[int] | None = None, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Formation rows, once for each of the ``horizon`` months after, with that month's return.

    The rows multiply by ``horizon``; name the ``deciles`` that are needed to keep
    only those before.
    """
    more = [weight] if weight else []
    formed = with_decile(df, signal, n, [*by, "month"]).where(F.col("decile").isNotNull())
    if deciles is not None:
        formed = formed.where(F.col("decile").isin(list(deciles)))
    n_tasks = parts(df)
    formed = formed.select(*by, "entity", F.col("month_idx").alias("formation"), "decile", *more, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("age"))
    keys = [*by, "entity", "month_idx"]
    formed = spread(formed.withColumn("month_idx", F.col("formation") + F.col("age")), *keys, n=n_tasks)
    # a plan's size does not know of the rows that explode makes: without a hint Spark may broadcast them
    held = spread(df.select(*by, "entity", "month_idx", "month", monthly), *keys, n=n_tasks)
    return formed.hint("merge").join(held, keys)


def cohorts(df: DataFrame, signal: str, monthly: str, horizon: int, n: int = 10, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Overlapping cohorts: ``by, month, decile, ret, n_cohorts``, pooled over all live positions."""
    keys = [*by, "month"]
    held = cohort_positions(df, signal, monthly, horizon, n, weight=weight, by=by)
    live = held.groupBy(*keys).agg(F.countDistinct("formation").alias("n_cohorts"))
    return decile_returns(held, monthly, keys, weight).join(live, keys)


def annual_rebalance(df: DataFrame, signal: str, target: str, horizon: int, n: int = 10, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Long-short of the H-month target in the months that are a multiple of ``min(H, 12)`` after the first.

    With ``by``, each portfolio counts from its own first month.
    """
    keys = [*by, "month"]
    start = F.broadcast(df.where(F.col(signal).isNotNull()).groupBy(*by).agg(F.min("month_idx").alias("__start")))
    kept = df.join(start, list(by)) if by else df.crossJoin(start)
    kept = kept.where((F.col("month_idx") - F.col("__start")) % min(horizon, 12) == 0).drop("__start")
    return long_short(decile_returns(with_decile(kept, signal, n, keys), target, keys, weight), n, keys)


CONSTRUCTIONS = ("monthly", "cohorts", "annual")


def constructions(principal: str, which: str | Sequence[str] = "all") -> list[str]:
    """Constructions to run: all, or those named, of which the principal must be one."""
    names = list(CONSTRUCTIONS) if which == "all" else [which] if isinstance(which, str) else list(which)
    if unknown := [n for n in names if n not in CONSTRUCTIONS]:
        raise ValueError(f"unknown constructions {unknown}")
    if principal not in names:
        raise ValueError("the principal construction must be among those that run")
    return names


def compare_constructions(df: DataFrame, signal: str, target: str, weight: str, share: float = 0.1, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """``by, construction, month, ret``: long-short and long-only, equal and weighted."""
    keys = [*by, "month"]
    ranked = with_decile(df, signal, n, keys)
    parts = {
        "long_short_equal": long_short(decile_returns(ranked, target, keys), n, keys),
        "long_short_weighted": long_short(decile_returns(ranked, target, keys, weight), n, keys),
        "long_only_equal": long_only(df, signal, target, share, keys),
        "long_only_weighted": long_only(df, signal, target, share, keys, weight),
    }
    out = None
    for name, part in parts.items():
        part = part.select(*by, F.lit(name).alias("construction"), "month", "ret")
        out = part if out is None else out.unionByName(part)
    return out


def construction_gaps(series: DataFrame, reference: str = "long_short_equal", by: str = "construction", within: Sequence[str] = ()) -> DataFrame:
    """Measures of each construction, and how far its Sharpe ratio is from the reference's (of the same ``within``)."""
    table = measures(series, [*within, by])
    base = F.broadcast(table.where(F.col(by) == reference).select(*within, F.col("sharpe").alias("__s")))
    both = table.join(base, list(within)) if within else table.crossJoin(base)
    return both.withColumn("sharpe_gap", F.col("sharpe") - F.col("__s")).drop("__s")


def compare_horizons(parts: Mapping[int, DataFrame], signal: str, target: str, monthly: str, n: int = 10) -> DataFrame:
    """One row a horizon: rank IC against its own target, its portfolio held a month at a time, and the Sharpe gap to the shortest.

    Each part has ``entity, month``, the signal, its own ``target`` and the ``monthly`` return; all are one job, keyed by horizon.
    """
    rows = None
    for h, part in parts.items():
        part = part.select(F.lit(h).alias("horizon"), "entity", "month", signal, target, monthly)
        rows = part if rows is None else rows.unionByName(part)
    rows = written(rows, "horizons")
    ic = rank_ic_summary(rank_ic(rows, signal, target, by=["horizon", "month"]), ["horizon"]).select("horizon", "ic_mean", "ic_t", F.col("n_months").alias("n_months_ic"))
    spread = long_short(decile_returns(with_decile(rows, signal, n, by=["horizon", "month"]), monthly, by=["horizon", "month"]), n, by=["horizon", "month"])
    out = ic.join(measures(spread, ["horizon"]), "horizon", "left")
    base = out.where(F.col("horizon") == min(parts)).select(F.col("sharpe").alias("__s"))
    return out.crossJoin(F.broadcast(base)).withColumn("sharpe_gap", F.col("sharpe") - F.col("__s")).drop("__s")


def universe_benchmarks(df: DataFrame, target: str, weight: str, by: Sequence[str] = (), keys: Sequence[str] = ("entity", "month")) -> DataFrame:
    """Equal- and size-weighted mean of all entities of a month, once each."""
    once = df.dropDuplicates([*by, *keys])
    w = F.when((F.col(weight) > 0) & F.col(target).isNotNull(), F.col(weight))
    return once.groupBy(*by, "month").agg(F.avg(target).alias("equal_weighted"), (F.sum(w * F.col(target)) / F.sum(w)).alias("size_weighted"))


def wealth(series: DataFrame, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Running product of 1 + return; one row per portfolio and month."""
    w = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return series.where("ret is not null").withColumn("wealth", F.product(1 + F.col("ret")).over(w))


def student_p(t: Column, n: Column) -> Column:
    """Two-sided p-value of a t statistic of ``n`` observations, right to some 1e-14.

    With whole degrees of freedom the distribution is a finite series in
    cos^2 = df / (df + t^2): n / 2 terms, added up in the JVM.
    """
    df = (n - 1).cast("long")
    even, cos2 = df % 2 == 0, df / (df + t * t)
    sine = F.abs(t) / F.sqrt(df + t * t)
    more = F.when(even, (df - 2) / 2).otherwise((df - 3) / 2).cast("long")
    start = F.struct(F.when(even, F.lit(1.0)).otherwise(F.sqrt(cos2)).alias("term"), F.when(even, F.lit(1.0)).otherwise(F.sqrt(cos2)).alias("total"))

    def step(x: Column, j: Column) -> Column:
        term = x["term"] * cos2 * F.when(even, (2 * j - 1) / (2 * j)).otherwise(2 * j / (2 * j + 1))
        return F.struct(term.alias("term"), (x["total"] + term).alias("total"))

    places = F.when(more >= 1, F.sequence(F.lit(1).cast("long"), more)).otherwise(F.array().cast("array<bigint>"))
    series = F.aggregate(places, start, step, lambda x: x["total"])
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    inside = F.when(even, sine * series).otherwise((angle + F.when(df > 1, sine * series).otherwise(F.lit(0.0))) * (2 / math.pi))
    return F.when((df >= 1) & t.isNotNull(), F.greatest(F.lit(0.0), 1 - inside))


def measures(series: DataFrame, by: Sequence[str] = ("portfolio",), periods: int = 12, p_value: bool = False) -> DataFrame:
    """Performance of each portfolio; all null under two months.

    The drawdown's peak starts at the first wealth value, so a loss in the first
    month is none; after a loss of everything in it there is no drawdown to speak
    of (null).  Skewness and excess kurtosis are those of the population.
    """
    path = wealth(series, by)
    peak = F.max("wealth").over(Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    path = path.withColumn("__dd", F.try_divide("wealth", peak) - 1)
    n = F.count("ret")
    out = path.groupBy(*by).agg(
        n.alias("n_months"), F.avg("ret").alias("__m"), F.stddev_samp("ret").alias("__s"), F.sqrt(F.avg(F.least("ret", F.lit(0.0)) ** 2)).alias("__d"),
        F.min("__dd").alias("__dd"), F.avg((F.col("ret") > 0).cast("double")).alias("__pos"), F.skewness("ret").alias("__sk"), F.kurtosis("ret").alias("__ku"),
    )
    some = F.col("n_months") >= 2
    when = lambda c: F.when(some, c)
    ratio = lambda a, b: F.when(some & (b > 0), a / b)
    p = float(periods)
    out = out.select(
        *by, "n_months",
        when(F.col("__m") * p).alias("mean_annual"),
        when(F.col("__s") * p**0.5).alias("volatility_annual"),
        ratio(F.col("__m") * p, F.col("__s") * p**0.5).alias("sharpe"),
        ratio(F.col("__m") * p, F.col("__d") * p**0.5).alias("sortino"),
        when(F.col("__dd")).alias("max_drawdown"),
        when(F.col("__pos")).alias("share_positive"),
        ratio(F.col("__m"), F.col("__s") / F.sqrt("n_months")).alias("t_stat"),
        when(F.col("__sk")).alias("skewness"),
        when(F.col("__ku")).alias("kurtosis"),
    )
    return out.withColumn("p_value", student_p(F.col("t_stat"), F.col("n_months"))) if p_value else out


def rank_ic(df: DataFrame, signal: str, target: str, by: Sequence[str] = ("month",), least: int = 10) -> DataFrame:
    """Correlation of average ranks in each cross-section; null under ``least`` rows or without variance."""
    df = df.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    ranked = average_ranks(df.select(*by, F.col(signal).alias("__a"), F.col(target).alias("__b")), ["__a", "__b"], by)
    ok = F.count(F.lit(1)) >= least
    return ranked.groupBy(*by).agg(F.when(ok, correlation("__a_rank", "__b_rank")).alias("ic"), F.count(F.lit(1)).alias("n"))


def rank_ic_summary(ic: DataFrame, by: Sequence[str] = (), periods: int = 12) -> DataFrame:
    one = ic.where("ic is not null").groupBy(*by).agg(F.count("ic").alias("n_months"), F.avg("ic").alias("__m"), F.stddev_samp("ic").alias("__s"), F.avg((F.col("ic") > 0).cast("double")).alias("__p"))
    some, moves = F.col("n_months") >= 2, (F.col("n_months") >= 2) & (F.col("__s") > 0)
    return one.select(
        *by, "n_months", F.when(some, F.col("__m")).alias("ic_mean"), F.when(some, F.col("__s")).alias("ic_sd"),
        F.when(moves, F.col("__m") / F.col("__s") * float(periods) ** 0.5).alias("ic_ir"),
        F.when(moves, F.col("__m") / (F.col("__s") / F.sqrt("n_months"))).alias("ic_t"), F.when(some, F.col("__p")).alias("share_positive"),
    )


def evaluate_groups(df: DataFrame, signal: str, target: str, group: str = "size_group", by: Sequence[str] = ("model",), n: int = 10) -> DataFrame:
    """Deciles made anew inside each group, and in the whole universe, then all measures: one job for all.

    ``by`` and ``group`` name a row; the universe is the group ``all``.
    """
    keys = [*by, group]
    both = ranked = with_decile(df.where(F.col(group).isNotNull()).unionByName(df.withColumn(group, F.lit("all"))), signal, n, by=[*keys, "month"])
    spread = long_short(decile_returns(ranked, target, by=[*keys, "month"]), n, by=[*keys, "month"])
    perf = measures(spread, keys)
    ic = rank_ic_summary(rank_ic(both, signal, target, by=[*keys, "month"]), keys).select(*keys, "ic_mean", "ic_t")
    fit = both.groupBy(*keys).agg((1 - F.try_divide(F.sum((F.col(target) - F.col(signal)) ** 2), F.sum(F.col(target) ** 2))).alias("r2"), F.count(F.lit(1)).alias("n_rows"))
    for column, name in (("entity", "n_entities"), ("month", "n_months_available")):
        fit = fit.join(_distinct(both, column, keys, name), keys)
    out = fit.join(perf, keys, "left").join(ic, keys, "left")
    out = out.withColumn("n_months_without", F.col("n_months_available") - F.coalesce("n_months", F.lit(0)))
    return out.select(*keys, "r2", "n_rows", "n_entities", "n_months_available", *[c for c in out.columns if c not in {*keys, "r2", "n_rows", "n_entities", "n_months_available"}])


def _distinct(df: DataFrame, column: str, by: Sequence[str], name: str) -> DataFrame:
    """Distinct values of each group; two of them in one aggregate would multiply the rows."""
    return spread(df.select(*by, column), *by, column).distinct().groupBy(*by).agg(F.count(column).alias(name))


def describe_groups(df: DataFrame, group: str = "size_group", size: str = "cap") -> DataFrame:
    """One row a group: rows, entities, months, rows a month, sizes and share of the whole.

    The rows are written, as three jobs read them: sums by group and month, from which
    all but quantiles and entities follow, a sort, and distinct entities.
    """
    df = written(df.where(F.col(group).isNotNull()).select("entity", "month", group, size), "described")
    monthly = df.groupBy(group, "month").agg(F.count(F.lit(1)).alias("n"), F.count(size).alias("k"), F.min(size).alias("low"), F.max(size).alias("high"), F.sum(size).alias("s"))
    one = monthly.groupBy(group).agg(
        F.sum("n").alias("n_rows"), F.count("month").alias("n_months"), F.avg("n").alias("mean_per_month"), F.min("n").alias("min_per_month"), F.max("n").alias("max_per_month"),
        F.min("low").alias("size_min"), F.try_divide(F.sum("s"), F.sum("k")).alias("size_mean"), F.max("high").alias("size_max"), F.sum("s").alias("__s"),
    )
    one = written(one, "groups")
    out = one.crossJoin(F.broadcast(one.agg(F.sum("__s").alias("__all")))).join(_distinct(df, "entity", [group], "n_entities"), group)
    out = out.join(group_quantiles(df, size, (0.25, 0.5, 0.75), [group]).withColumnRenamed("__q", "q"), group, "left")
    return out.select(group, "n_rows", "n_entities", "n_months", "mean_per_month", "min_per_month", "max_per_month", "size_min", F.get("q", F.lit(0)).alias("size_p25"), F.get("q", F.lit(1)).alias("size_median"), "size_mean", F.get("q", F.lit(2)).alias("size_p75"), "size_max", F.try_divide("__s", "__all").alias("share_of_total"))


def group_bounds(df: DataFrame, group: str = "size_group", size: str = "cap") -> DataFrame:
    df = df.where(F.col(group).isNotNull())
    one = df.groupBy("month", group).agg(F.min(size).alias("size_min"), F.max(size).alias("size_max"), F.count(F.lit(1)).alias("n"))
    median = group_quantiles(df, size, [0.5], ["month", group]).select("month", group, F.get("__q", F.lit(0)).alias("size_median"))
    return one.join(median, ["month", group], "left").select("month", group, "size_min", "size_median", "size_max", "n")


def largest(df: DataFrame, size: str = "cap", n: int = 10) -> DataFrame:
    """The ``n`` largest sizes and whose they are; ties by entity, then month."""
    return df.where(F.col(size).isNotNull()).orderBy(F.desc(size), "entity", "month").limit(n).select("entity", "month", size)


def partition_check(df: DataFrame, group: str = "size_group") -> DataFrame:
    """Entity-months in groups, left out, and in all; the first two make the third."""
    once = df.dropDuplicates(["entity", "month"])
    return once.agg(F.count(group).alias("n_grouped"), F.count_if(F.col(group).isNull()).alias("n_excluded"), F.count(F.lit(1)).alias("n_universe"))


def best_by(table: DataFrame, model: str, group: str, columns: Sequence[str]) -> DataFrame:
    """Per model, the group with the highest value of each column; ties to the smaller name."""
    order = Window.partitionBy(model).orderBy(group)
    named = table.withColumn("__o", -F.row_number().over(order))
    return named.groupBy(model).agg(*[F.max_by(group, F.struct(c, "__o")).alias(f"best_{c}") for c in columns])


def scale_ratio(df: DataFrame, short: str, long: str) -> DataFrame:
    """Deviations of two targets and the ratio of their variances, null where the short one is constant."""
    return df.agg(F.stddev_samp(short).alias("sd_short"), F.stddev_samp(long).alias("sd_long")).withColumn("variance_ratio", F.try_divide("sd_long", "sd_short") ** 2)


def rank_disagreement(table: DataFrame, accuracy: str = "r2", value: str = "sharpe") -> DataFrame:
    """Ranks by accuracy and by value, and whether they differ.  A few rows: one per model."""
    r = lambda c: F.rank().over(Window.orderBy(F.desc(c)))
    return table.withColumn("rank_accuracy", r(accuracy)).withColumn("rank_value", r(value)).withColumn("disagree", F.col("rank_accuracy") != F.col("rank_value"))

