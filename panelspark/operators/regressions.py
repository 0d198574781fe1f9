"""Small regressions by group: OLS from Gram sums, Fama-MacBeth, Newey-West, factor alphas."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelspark.operators.ensemble import gram, gram_names
from panelspark.operators.joins import common_months
from panelspark.operators.portfolios import measures

#: Nested factor models, from one factor to six.
MODELS = {"CAPM": ["mktrf"], "FF3": ["mktrf", "smb", "hml"], "FF5": ["mktrf", "smb", "hml", "rmw", "cma"], "FF5+MOM": ["mktrf", "smb", "hml", "rmw", "cma", "mom"]}


def _solve(r, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their OLS standard errors and the error variance from one row of Gram sums."""
    xx = np.array([[getattr(r, f"xx_{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)], float)
    xy = np.array([getattr(r, f"xy_{i}") for i in range(k)], float)
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    s2 = max(r.yy - beta @ xy, 0.0) / max(r.n - k, 1)
    return beta, np.sqrt(np.maximum(np.diag(inverse) * s2, 0)), s2


def coefficients(sums: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``by, predictor, coefficient, std_error`` from Gram rows with intercept; groups with n <= k are left out.

    Only the reduced rows reach Python: one k x k system a group.
    """
    k, all_names = len(names) + 1, ["intercept", *names]
    schema = T.StructType([*[sums.schema[c] for c in by], T.StructField("predictor", T.StringType()), T.StructField("coefficient", T.DoubleType()), T.StructField("std_error", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                beta, se, _ = _solve(r, k)
                out += [(*[getattr(r, c) for c in by], p, float(b), float(s)) for p, b, s in zip(all_names, beta, se)]
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return sums.where(F.col("n") > k).select(*by, *gram_names(k)).mapInPandas(run, schema)


def window_ols(panel: DataFrame, windows: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """OLS of every window in one pass: monthly sums, added up over each window's training months."""
    monthly = gram(panel, names, target, intercept=True)
    k = len(names) + 1
    train = windows.where("block = 'train'").select("window_id", "month")
    sums = monthly.join(train, "month").groupBy("window_id").agg(*[F.sum(c).alias(c) for c in gram_names(k)])
    return coefficients(sums, names, ["window_id"])


def predict(rows: DataFrame, coefs: DataFrame, names: Sequence[str], on: Sequence[str] = ("window_id",)) -> DataFrame:
    """Linear predictions with each window's coefficients; a few rows a window, so broadcast."""
    wide = coefs.groupBy(*on).pivot("predictor", ["intercept", *names]).agg(F.first("coefficient"))
    wide = wide.withColumnsRenamed({c: f"__b_{c}" for c in ["intercept", *names]})
    total = F.col("__b_intercept") + sum((F.col(c) * F.col(f"__b_{c}") for c in names), F.lit(0.0))
    return rows.join(F.broadcast(wide), list(on)).withColumn("prediction", total).drop(*[f"__b_{c}" for c in ["intercept", *names]])


def monthly_slopes(panel: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """First pass of Fama-MacBeth: slopes and standard errors of each month's regression."""
    return coefficients(gram(panel, names, target, intercept=True), names, ["month", "month_idx"])


def newey_west(series: DataFrame, value: str, by: Sequence[str] = ("predictor",), order: str = "month_idx", lags: int | None = None, small_sample: bool = False) -> DataFrame:
    """Mean of each series with a Newey-West error: ``n, mean, nw_se, t_stat, share_positive``.

    Lags: given, or ``max(1, floor(4 (T / 100)^(2/9)))``.  Products of a value with
    later ones come from one self-join on the position, weights by Bartlett.  A
    single value has no error with ``small_sample``.
    """
    rows = series.where(F.col(value).isNotNull())
    stat = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("share_positive"))
    length = F.lit(lags) if lags is not None else F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9)))).cast("int")
    stat = stat.withColumn("lags", length)
    at = rows.select(*by, F.col(value).alias("v"), F.row_number().over(Window.partitionBy(*by).orderBy(order)).alias("p")).join(stat.select(*by, "mean", "lags"), list(by)).withColumn("e", F.col("v") - F.col("mean"))
    ahead = at.select(*by, "p", "e", F.explode(F.sequence(F.lit(0), "lags")).alias("lag"), "lags").withColumn("q", F.col("p") + F.col("lag"))
    other = at.select(*by, F.col("p").alias("q"), F.col("e").alias("e2"))
    weight = F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(2 * (1 - F.col("lag") / (F.col("lags") + 1)))
    total = ahead.join(other, [*by, "q"]).groupBy(*by).agg(F.sum(weight * F.col("e") * F.col("e2")).alias("s"))
    scale = F.try_divide("n", F.col("n") - 1) if small_sample else F.lit(1.0)
    out = stat.join(total, list(by)).withColumn("nw_se", F.sqrt(F.greatest(F.col("s"), F.lit(0.0)) * scale) / F.col("n"))
    return out.select(*by, "n", "lags", "mean", "nw_se", F.when(F.col("nw_se") > 0, F.col("mean") / F.col("nw_se")).alias("t_stat"), "share_positive")


@F.pandas_udf(T.DoubleType())
def normal_p(t: pd.Series) -> pd.Series:
    """Two-sided p-value under the normal law."""
    return pd.Series([math.erfc(abs(x) / math.sqrt(2)) if x == x else None for x in t], dtype="float64")


def fama_macbeth(panel: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Mean monthly slope of each predictor with Newey-West errors, p and a 5 % flag."""
    out = newey_west(monthly_slopes(panel, names, target), "coefficient")
    return out.withColumn("p_value", normal_p("t_stat")).withColumn("significant", F.col("p_value") < 0.05)


def window_significance(slopes: DataFrame, windows: DataFrame, least: int = 6) -> DataFrame:
    """Per training window and predictor: share of months with abs(t) >= 1.96 (never where the error is 0), and signed coherence mean(b) / mean(abs(b))."""
    rows = slopes.join(F.broadcast(windows.where("block = 'train'").select("window_id", "month")), "month")
    strong = F.coalesce(F.abs(F.try_divide("coefficient", "std_error")) >= 1.96, F.lit(False)).cast("double")
    size = F.avg(F.abs("coefficient"))
    out = rows.groupBy("window_id", "predictor").agg(F.count(F.lit(1)).alias("n_months"), F.avg(strong).alias("share_significant"), F.when(size > 0, F.avg("coefficient") / size).alias("coherence"))
    return out.where(F.col("n_months") >= least)


def default_lags(horizon: int) -> int:
    return 3 if horizon == 1 else max(3, horizon - 1)


def _hac(y: np.ndarray, x: np.ndarray, lags: int, periods: int) -> dict:
    """OLS with intercept and Newey-West errors with small-sample correction."""
    n, k = len(y), x.shape[1]
    nothing = {"n_months": n, "alpha": None, "alpha_annual": None, "t_alpha": None, "r2": None, "residual_vol": None, "information_ratio": None, "betas": None, "t_betas": None}
    if n <= k + 1:
        return nothing
    z = np.column_stack([np.ones(n), x])
    inverse = np.linalg.pinv(z.T @ z)
    beta = inverse @ z.T @ y
    e = y - z @ beta
    spread = ((y - y.mean()) ** 2).sum()
    r2 = 1 - (e @ e) / spread if spread > 0 else None
    u = z * e[:, None]
    s = u.T @ u
    for lag in range(1, min(lags, n - 1) + 1):
        g = u[lag:].T @ u[:-lag]
        s += (1 - lag / (lags + 1)) * (g + g.T)
    v = inverse @ s @ inverse * n / (n - k - 1)
    se = np.sqrt(np.maximum(np.diag(v), 0))
    vol = math.sqrt(e @ e / (n - k - 1))
    t = [float(b / q) if q > 0 else None for b, q in zip(beta, se)]
    out = {"n_months": n, "alpha": float(beta[0]), "alpha_annual": float(beta[0]) * periods, "t_alpha": t[0], "r2": r2, "residual_vol": vol * math.sqrt(periods), "information_ratio": float(beta[0]) * periods / (vol * math.sqrt(periods)) if vol > 0 else None, "betas": [float(b) for b in beta[1:]], "t_betas": t[1:]}
    if r2 is not None and r2 > 1 - 1e-10:  # the factors span the series: there is no alpha to test
        out |= {"alpha": 0.0, "alpha_annual": 0.0, "t_alpha": None, "information_ratio": None}
    return out


def factor_alphas(series: DataFrame, factors: DataFrame, models: Mapping[str, Sequence[str]] = MODELS, lags: int = 3, by: Sequence[str] = ("portfolio",), periods: int = 12) -> DataFrame:
    """Alpha of every portfolio under every factor model, one row each.

    A group is one portfolio's months, some hundreds of rows however large the
    panel was.
    """
    names = sorted({f for m in models.values() for f in m})
    rows = series.where("ret is not null").select(*by, "month", "ret").join(F.broadcast(factors.select("month", *names).na.drop()), "month")
    fields = [("factor_model", T.StringType()), ("n_months", T.LongType()), *[(c, T.DoubleType()) for c in ("alpha", "alpha_annual", "t_alpha", "r2", "residual_vol", "information_ratio")], ("betas", T.ArrayType(T.DoubleType())), ("t_betas", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*[rows.schema[c] for c in by], *[T.StructField(n, t) for n, t in fields]])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        y = pdf["ret"].to_numpy()
        out = [dict(zip(by, key)) | {"factor_model": m} | _hac(y, pdf[list(fs)].to_numpy(), lags, periods) for m, fs in models.items()]
        return pd.DataFrame(out, columns=[f.name for f in schema])

    return rows.groupBy(*by).applyInPandas(run, schema).withColumn("p_alpha", normal_p("t_alpha"))


def one_factor(series: DataFrame, factors: DataFrame, factor: str = "mktrf", by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Alpha, beta and R2 on a single factor, by regression aggregates."""
    rows = series.join(F.broadcast(factors.select("month", factor)), "month")
    return rows.groupBy(*by).agg(F.regr_intercept("ret", factor).alias("alpha"), F.regr_slope("ret", factor).alias("beta"), F.regr_r2("ret", factor).alias("r2"), F.count("ret").alias("n_months"))


def absorbed_alpha(alphas: DataFrame, by: Sequence[str] = ("portfolio",), small: str = "FF5", large: str = "FF5+MOM") -> DataFrame:
    """Annual alpha under two models and what the larger one absorbs."""
    wide = alphas.groupBy(*by).pivot("factor_model", [small, large]).agg(F.first("alpha_annual"))
    return wide.select(*by, F.col(f"`{small}`").alias("alpha_small"), F.col(f"`{large}`").alias("alpha_large"), (F.col(f"`{small}`") - F.col(f"`{large}`")).alias("absorbed"))


def factor_series(factors: DataFrame, names: Sequence[str]) -> DataFrame:
    """Factors as portfolios: ``portfolio, month, month_idx, ret``."""
    return factors.select("month", "month_idx", *names).unpivot(["month", "month_idx"], list(names), "portfolio", "ret")


def factor_benchmark(factors: DataFrame, names: Sequence[str], rule: str = "equal", window: int = 60, least: int = 24) -> DataFrame:
    """A portfolio of factors: equal mean, or past inverse variances (equal under ``least`` months).

    A factor that never varied has no weight; without any weight the return is null.
    """
    long = factor_series(factors, names)
    if rule == "equal":
        return long.groupBy("month", "month_idx").agg(F.avg("ret").alias("ret"))
    if rule != "inverse_variance":
        raise ValueError("equal or inverse_variance")
    past = Window.partitionBy("portfolio").orderBy("month_idx").rowsBetween(-window, -1)
    rows = long.withColumn("n", F.count("ret").over(past)).withColumn("i", F.try_divide(F.lit(1.0), F.var_samp("ret").over(past)))
    rows = rows.withColumn("w", F.when(F.col("n") >= least, F.col("i")).otherwise(F.lit(1.0)))
    return rows.groupBy("month", "month_idx").agg(F.try_divide(F.sum(F.col("w") * F.col("ret")), F.sum("w")).alias("ret"))


def report_alphas(alphas: DataFrame, factor_model: str, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """One factor model's rows in percent, for a table."""
    pct = [(100 * F.col(c)).alias(f"{c}_pct") for c in ("alpha_annual", "r2", "residual_vol")]
    return alphas.where(F.col("factor_model") == factor_model).select(*by, *pct, "t_alpha", "information_ratio", "n_months")


def lost_significance(gross: DataFrame, net: DataFrame, by: Sequence[str] = ("portfolio", "factor_model"), t: float = 1.96) -> DataFrame:
    """Rows whose gross alpha is significant and whose net alpha is not."""
    both = gross.select(*by, F.col("t_alpha").alias("t_gross")).join(net.select(*by, F.col("t_alpha").alias("t_net")), list(by))
    return both.where((F.col("t_gross") >= t) & (F.coalesce("t_net", F.lit(0.0)) < t))


def verdict(models: DataFrame, benchmark_sharpe: DataFrame, alphas: DataFrame, t: float = 1.96) -> DataFrame:
    """Sharpe gap to the benchmark (a one-row table ``sharpe``) and whether the alpha is significant."""
    rows = models.select("portfolio", "sharpe").crossJoin(F.broadcast(benchmark_sharpe.select(F.col("sharpe").alias("__b"))))
    rows = rows.join(alphas.select("portfolio", "t_alpha"), "portfolio", "left")
    return rows.select("portfolio", "sharpe", (F.col("sharpe") - F.col("__b")).alias("sharpe_gap"), (F.coalesce("t_alpha", F.lit(0.0)) >= t).alias("alpha_significant"))


def compare_to_factors(models: DataFrame, benchmark: DataFrame, factors: DataFrame, alphas: DataFrame) -> DataFrame:
    """Measures of models, benchmark and single factors over the months that all share, with annual alpha, in order.

    The first three hold ``portfolio, month, ret``; ``alphas`` ``portfolio, alpha_annual``.  Factors have
    no alpha.  ``place`` counts models first, then the benchmark, then factors, each by Sharpe ratio.
    """
    kinds = ("model", "benchmark", "factor")
    parts = [part.select(F.lit(kind).alias("kind"), "portfolio", "month", "ret") for kind, part in zip(kinds, (models, benchmark, factors))]
    series = common_months(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    table = measures(series, ["kind", "portfolio"]).join(F.broadcast(alphas.select("portfolio", "alpha_annual")), "portfolio", "left")
    table = table.withColumn("alpha_annual", F.when(F.col("kind") != "factor", F.col("alpha_annual")))
    order = Window.orderBy(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.desc_nulls_last("sharpe"), "portfolio")  # a row a portfolio
    return table.withColumn("place", F.row_number().over(order))


def factor_coverage(series: DataFrame, factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Months per portfolio that have factors; and the months that have none."""
    have = factors.select("month").distinct()
    return series.join(have, "month", "left_semi").groupBy("portfolio").agg(F.countDistinct("month").alias("n_months")), series.select("month").distinct().join(have, "month", "left_anti")


def coefficient_stability(coefs: DataFrame, by: str = "predictor") -> DataFrame:
    """Mean size over windows, percent of windows that use the predictor, its mean where used, dominant sign and agreement."""
    b = F.col("coefficient")
    used = b != 0
    n = F.count_if(used)
    positive = F.count_if(b > 0) / n
    rows = coefs.where(F.col(by) != "intercept").groupBy(by).agg(
        F.avg(F.abs(b)).alias("mean_abs"), (100 * F.avg(used.cast("double"))).alias("pct_selected"), F.avg(F.when(used, b)).alias("mean_if_selected"),
        F.when(n > 0, F.when(positive >= 0.5, 1).otherwise(-1)).alias("dominant_sign"), F.when(n > 0, 100 * F.greatest(positive, 1 - positive)).alias("pct_agreement"),
        (F.abs(F.sum(F.signum(b))) == F.sum(F.abs(F.signum(b)))).alias("sign_stable"),
    )
    return rows

