"""Operators on hand-made tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import keys
from panelspark.operators import costs as C
from panelspark.operators import ensemble as E
from panelspark.operators import horizon as H
from panelspark.operators import journal as G
from panelspark.operators import models as M
from panelspark.operators import portfolios as P
from panelspark.operators import regressions as R
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.sources import ingest as I


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_numbers_and_codes(spark):
    df = spark.createDataFrame([("0.01",), ("C",), ("B",), (None,), ("4,796.56",)], "x string")
    assert [r[0] for r in rows(df.select(I.number("x")))] == [0.01, None, None, None, 4796.56]
    assert sorted(rows(I.non_numeric_codes(df, "x"))) == [("4,796.56", 1), ("B", 1), ("C", 1)]


def test_factor_text(spark, tmp_path):
    path = tmp_path / "five.csv"
    path.write_text("a note\n,Mkt-RF,SMB,H ML\n200001, 1.5,-2,0.1\n200002,2,x,0\n\nAnnual\n,Mkt-RF,SMB,H ML\n2000,3,4,5\n")
    df = I.factor_text(spark, str(path))
    assert df.columns == ["month", "mktrf", "smb", "hml"]
    assert sorted(rows(df)) == [("200001", 1.5, -2.0, 0.1), ("200002", 2.0, None, 0.0)]
    (tmp_path / "none.csv").write_text("200001,1\n")
    with pytest.raises(ValueError):
        I.factor_text(spark, str(tmp_path / "none.csv"))


def test_nan_is_null_and_keys_are_unique(spark):
    df = keys.nan_to_null(spark.createDataFrame([(1, float("nan")), (1, 2.0)], "k int, x double"))
    assert sorted(rows(df), key=str) == [(1, 2.0), (1, None)]
    with pytest.raises(ValueError):
        keys.expect_unique(df, ["k"])
    with pytest.raises(ValueError):
        keys.expect_not_null(df, ["x"])


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 23, 100])
def test_deciles(spark, n):
    df = spark.createDataFrame([(i, "200001", float(i // 2)) for i in range(n)], "entity long, month string, s double")
    got = [r["d"] for r in df.select("entity", X.decile("s").alias("d")).orderBy("entity").collect()]
    want = [None] * n if n < 10 else [max(1, ((r - 1) * 10 + n - 2) // (n - 1)) for r in range(1, n + 1)]
    assert got == want


def test_imputation_levels(spark):
    long = spark.createDataFrame([(1, "a", "f", 1.0), (2, "a", "f", None), (1, "b", "f", None), (1, "a", "g", None)], "entity int, month string, feature string, x double")
    got = {(r["entity"], r["month"], r["feature"]): r["x"] for r in X.impute_median(long).collect()}
    assert got == {(1, "a", "f"): 1.0, (2, "a", "f"): 1.0, (1, "b", "f"): 1.0, (1, "a", "g"): 0.0}
    there = X.impute_median(long.where("month = 'a' and feature = 'f'"))
    assert sorted((r["entity"], r["x"]) for r in there.collect()) == [(1, 1.0), (2, 1.0)]


@pytest.mark.parametrize("small", [True, False])
def test_whole_quantiles_are_exact(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(X, "SMALL_GROUP", 0)
    random.seed(6)
    data = [("a", random.gauss(0, 1)) for _ in range(3001)] + [("b", float(random.randrange(4))) for _ in range(2000)] + [("c", None), ("a", None), ("d", 7.0), ("e", 1.0), ("e", 2.0)]
    df = spark.createDataFrame(data, "g string, x double")
    at = [0.001, 0.25, 0.5, 0.999]
    got = {r["g"]: r["q"] for r in X.whole_quantiles(df, "x", at, ["g"]).collect()}
    for g in "abde":
        assert got[g] == pytest.approx(list(np.quantile([x for k, x in data if k == g and x is not None], at)), abs=1e-12)
    assert got["c"] is None
    assert X.whole_quantiles(df, "x", at).first()["q"] == pytest.approx(list(np.quantile([x for _, x in data if x is not None], at)), abs=1e-12)
    assert rows(X.whole_quantiles(df.limit(0), "x", [0.5])) == [([None],)]


def test_sketches_that_miss_cost_passes_not_results(spark, monkeypatch):
    monkeypatch.setattr(X, "SMALL_GROUP", 0)
    monkeypatch.setattr(X, "SKETCH_ACCURACY", 20)
    monkeypatch.setattr(X, "POINTS", 16)
    half = F.when(F.col("id") % 2 == 0, F.lit(500.0)).otherwise(F.col("id").cast("double"))  # one value holds half of all rows
    df = spark.range(3000).select(half.alias("x"), F.when(F.col("id") < 3, F.lit(None)).otherwise(F.col("id") % 3).alias("g"))
    data = [(r["g"], r["x"]) for r in df.collect()]
    at = [0.0, 0.2, 0.37, 0.5, 0.999, 1.0]
    got = {r["g"]: r["q"] for r in X.whole_quantiles(df, "x", at, ["g"]).collect()}
    assert set(got) == {None, 0, 1, 2}
    for g in got:
        assert got[g] == pytest.approx(list(np.quantile([x for k, x in data if k == g], at)), abs=1e-9)


def test_quantiles_of_columns_use_no_window(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"))
    for out in (X.whole_quantiles(df, "x", [0.5]), I.profile(df, ["x"]), I.extremes(df, "x")):
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_size_groups_are_checked():
    for bad in [("other", (0.5,), ("a", "b")), ("percentile", (0.5,), ("a",)), ("percentile", (0.6, 0.5), ("a", "b", "c")), ("percentile", (2.0,), ("a", "b")), ("fixed", (1.0,), (None, None)), ("fixed", (1.0,), ("a", "a"))]:
        with pytest.raises(ValueError):
            X.SizeGroups(*bad)


@pytest.mark.parametrize("policy", H.POLICIES)
def test_forward_return_with_gap_and_delisting(spark, policy):
    ret = [(1, m, 0.1) for m in range(1, 13) if m != 6] + [(2, m, 0.1) for m in range(1, 5)] + [(3, m, -1.0 if m == 2 else 0.0) for m in range(1, 13)]
    returns = spark.createDataFrame(ret, "entity long, month_idx int, ret double")
    macro = spark.createDataFrame([(m, 0.01) for m in range(1, 13)], "month_idx int, rf double")
    got = {(r["entity"], r["month_idx"]): r for r in H.forward_excess(returns, macro, 3, policy).collect()}
    assert got[1, 3]["target"] is None and got[1, 5]["target"] is None  # month 6 is missing
    assert got[1, 7]["target"] == pytest.approx(1.1**3 - 1.01**3)
    assert got[1, 10]["target"] is None  # past the panel's end
    assert got[2, 4]["target"] == pytest.approx((1.01**3 if policy == "risk_free" else 1.0) - 1.01**3)
    assert got[2, 4]["n_observed"] == 0 and got[2, 4]["status"] == "delisted"
    assert got[3, 1]["target"] == pytest.approx(1e-6 - 1.01**3, abs=1e-9)
    assert (2, 5) not in got
    with pytest.raises(ValueError):
        H.forward_excess(returns, macro, 3, "other")


def weights(spark, table):
    return spark.createDataFrame([("long", f"2000{m:02d}", m, e, w) for m, e, w in table], "leg string, month string, month_idx int, entity long, w double")


def test_turnover(spark):
    w = weights(spark, [(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.5), (2, 2, 0.5), (4, 3, 1.0)])
    r = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0)], "month_idx int, entity long, r double")
    got = {x["month_idx"]: x for x in C.turnover(w, r).collect()}
    assert got[1]["turnover"] == 1.0
    assert got[2]["turnover"] == pytest.approx(1 / 3) and got[2]["entries_exits"] == 0
    assert got[4]["turnover"] == 2.0 and got[4]["rebalancing"] == 0
    assert all(x["turnover"] == pytest.approx(x["entries_exits"] + x["rebalancing"]) for x in got.values())


def test_buffer_against_a_loop(spark):
    random.seed(3)
    data = [(e, m, random.choice([None, *range(6, 11)])) for e in range(20) for m in range(1, 15) if random.random() < 0.85]
    df = spark.createDataFrame(data, "entity long, month_idx int, decile int")
    got = {(r["entity"], r["month_idx"]): r["held"] for r in C.buffered(df, 10, 8).collect()}
    inside, want = set(), {}
    for m in sorted({m for _, m, _ in data}):
        now = {e: d for e, x, d in data if x == m}
        inside = {e for e in now if now[e] is not None and (now[e] >= 10 or (now[e] >= 8 and e in inside))}
        want |= {(e, m): e in inside for e in now}
    assert got == want


def test_break_even_significance_against_bisection(spark):
    rng = np.random.default_rng(1)
    g, q = rng.normal(0.02, 0.03, 60), rng.uniform(0.5, 1.5, 60)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(g, q)], "ret double, turnover double")
    got = C.break_even(df).first()["significance_bps"]
    t = lambda c: (g - q * c / 1e4).mean() / ((g - q * c / 1e4).std(ddof=1) / math.sqrt(60))
    assert t(got) == pytest.approx(1.96, abs=1e-6)


def test_simplex_weights():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, y = rng.normal(size=(50, 3)), rng.normal(size=50)
        w = E.simplex_least_squares(x.T @ x, x.T @ y, y @ y)
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        best = min(((y - x @ np.array([a, b, 1 - a - b])) ** 2).sum() for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1 - a, 41))
        assert ((y - x @ w) ** 2).sum() <= best + 1e-9


def test_combination_is_checked():
    for bad in [(["a"], "equal"), (["a", "a"], "equal"), (["a", "b"], "other"), (["a", "b"], "manual")]:
        with pytest.raises(ValueError):
            E.check(*bad)


def test_student_p(spark):
    """Known values, and the series against numbers from the density, for odd and even degrees of freedom."""
    known = [(2.0, 11, 0.07338803), (5.0, 3, 0.03774955), (0.0, 6, 1.0), (1.0, 2, 0.5), (-2.0, 11, 0.07338803), (None, 9, None), (1.0, 1, None)]
    for t, n in [(0.3, 4), (1.7, 145), (2.5, 144), (0.9, 1001)]:
        x = np.linspace(0, t, 200_001)
        nu = n - 1
        density = np.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi) * (1 + x * x / nu) ** (-(nu + 1) / 2)
        known.append((t, n, 1 - 2 * float(np.trapezoid(density, x))))
    df = spark.createDataFrame(known, "t double, n long, want double").select("want", P.student_p(F.col("t"), F.col("n")).alias("p"))
    for r in df.collect():
        assert (r["want"] is None and r["p"] is None) or r["p"] == pytest.approx(r["want"], abs=1e-7)


def test_spanned_portfolio_has_no_alpha(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=(40, 6))
    factors = spark.createDataFrame([(f"m{i:02d}", *map(float, r)) for i, r in enumerate(f)], "month string, mktrf double, smb double, hml double, rmw double, cma double, mom double")
    series = spark.createDataFrame([("p", f"m{i:02d}", float(0.5 * r[0] + 0.5 * r[1])) for i, r in enumerate(f)] + [("q", "m00", 1.0)], "portfolio string, month string, ret double")
    got = {(r["portfolio"], r["factor_model"]): r for r in R.factor_alphas(series, factors).collect()}
    assert got["p", "FF3"]["alpha"] == 0 and got["p", "FF3"]["t_alpha"] is None
    assert got["p", "CAPM"]["t_alpha"] is not None
    assert got["q", "CAPM"]["alpha"] is None and got["q", "CAPM"]["n_months"] == 1


def test_fama_macbeth_recovers_slopes(spark):
    rng = np.random.default_rng(5)
    data = [(f"2000{m:02d}", m, float(a), float(b), float(0.5 * a - b + 0.01 * rng.normal())) for m in range(1, 13) for a, b in rng.normal(size=(30, 2))]
    df = spark.createDataFrame(data, "month string, month_idx int, a double, b double, y double")
    got = {r["predictor"]: r for r in R.fama_macbeth(df, ["a", "b"], "y").collect()}
    assert got["a"]["mean"] == pytest.approx(0.5, abs=0.01) and got["b"]["significant"]


def test_windows(spark):
    months = spark.createDataFrame([(f"{y}{m:02d}", y * 12 + m) for y in range(1990, 2000) for m in range(1, 13)], "month string, month_idx int")
    for mode in W.MODES:
        t = W.windows(months, W.WindowPlan(mode, 4, 2, 1)).collect()
        tests = sorted({r["test_year"] for r in t})
        assert tests == [1996, 1997, 1998, 1999]
        first = {w: min(r["month"] for r in t if r["window_id"] == w and r["block"] == "train") for w in range(1, 5)}
        assert first[4] == ("199001" if mode == "expanding" else "199301")
    late = W.embargo(W.windows(months, W.WindowPlan("rolling", 4, 2, 1)), 3).where("window_id = 1").groupBy("block").count().collect()
    assert {r["block"]: r["count"] for r in late} == {"train": 45, "validation": 21, "test": 12}
    with pytest.raises(ValueError):
        W.WindowPlan("other")


def test_models_train_and_tell_the_truth(spark):
    rng = np.random.default_rng(4)
    data = [(i, f"20{y:02d}01", b, float(x), float(2 * x)) for y, b in ((0, "train"), (1, "validation"), (2, "test")) for i, x in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame(data, "entity long, month string, block string, x double, y double").withColumn("window_id", F.lit(1))
    t = M.train(M.Spec("ols", M.linear, [{}]), df, ["x"], "y")
    assert t.results.first()["r2_test"] == pytest.approx(1.0)
    assert t.predictions.count() == 40 and t.grid.first()["selected"]
    assert M.grid(a=[1, 2], b=[3]) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_boosting_stops_where_validation_says(spark):
    random.seed(3)
    noise = lambda x: (x > 0.5) + random.gauss(0, 1)
    data = [(i, i % 7, x, z, noise(x), 1, b) for b, n in (("train", 60), ("validation", 400), ("test", 40)) for i in range(n) for x, z in [(random.random(), random.random())]]
    df = spark.createDataFrame(data, "entity long, month int, x double, z double, y double, window_id int, block string").coalesce(1)
    combos = M.grid(depth=[5], trees=[12], rate=[0.5])
    t = M.train(M.Spec("boosting", M.boosting, combos), df, ["x", "z"], "y")
    got = t.results.first()
    ready = M.VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df.withColumnRenamed("y", "label"))
    part = lambda b: ready.where(F.col("block") == b)
    full = M.boosting(combos[0]).fit(part("train"))
    errors = full.evaluateEachIteration(part("validation"), "squared")
    best = errors.index(min(errors)) + 1
    assert best < 12 and got["best_trees"] == best and got["params"] == str(combos[0])
    first = lambda v: sum(w * m.predict(v) for w, m in zip(full.treeWeights[:best], full.trees[:best]))
    want = {r["entity"]: first(r["features"]) for r in part("test").collect()}
    assert {r["entity"]: r["prediction"] for r in t.predictions.collect()} == pytest.approx(want)
    squares = [r["label"] ** 2 for r in part("validation").collect()]
    assert got["r2_validation"] == pytest.approx(1 - min(errors) * len(squares) / sum(squares))
    used = {r["predictor"]: r["coefficient"] for r in t.weights.collect()}
    cut = M.boosting(combos[0] | {"trees": best}).fit(part("train")).featureImportances.toArray()
    assert [used["x"], used["z"]] == pytest.approx(list(cut))


def test_constant_series_divide_nothing(spark):
    zero = spark.createDataFrame([("g", 0.0, 0.1), ("h", 1.0, 1.0), ("h", 1.0, 0.0)], "g string, y double, prediction double")
    assert sorted(rows(W.r2_table(zero, ["g"]))) == [("g", None, 1), ("h", 0.5, 2)]
    lost = spark.createDataFrame([("long", 1, 7, 0.5), ("long", 1, 8, 0.5)], "leg string, month_idx int, entity int, w double")
    gone = spark.createDataFrame([(1, 7, -1.0), (1, 8, -1.0)], "month_idx int, entity int, r double")
    assert [r["drifted"] for r in C.drifted(lost, gone).collect()] == [None, None]
    still = spark.createDataFrame([(0.01, 0.0)] * 3, "ret double, turnover double")
    assert rows(C.turnover_summary(still)) == [(0.0, 0.0, None, 3)]
    assert rows(C.break_even(still)) == [(3, None, 0.0)]
    slopes = spark.createDataFrame([(f"2000{m:02}", "x", 0.5, 0.0) for m in range(1, 8)], "month string, predictor string, coefficient double, std_error double")
    train = slopes.select(F.lit(1).alias("window_id"), F.lit("train").alias("block"), "month")
    assert rows(R.window_significance(slopes, train)) == [(1, "x", 7, 0.0, 1.0)]
    flat = spark.createDataFrame([(f"m{m:02}", m, 0.01) for m in range(30)], "month string, month_idx int, a double")
    assert {r["month"]: r["ret"] for r in R.factor_benchmark(flat, ["a"], "inverse_variance").collect()}["m29"] is None
    assert rows(P.scale_ratio(flat, "a", "a")) == [(0.0, 0.0, None)]
    unused = spark.createDataFrame([(1, "x", 0.0), (1, "z", 0.0)], "window_id int, predictor string, coefficient double")
    assert {(r["mean_share"], r["pct_unused"]) for r in M.importance_table(unused).collect()} == {(None, 100.0)}


def test_error_free_model_has_all_the_weight(spark):
    wide = spark.createDataFrame([(f"m{m:02}", m, 1, float(m), float(m), 0.0) for m in range(30)], "month string, month_idx int, entity int, y double, a double, b double")
    weights = E.inverse_mse_weights(E.gram(wide, ["a", "b"], "y"), ["a", "b"])
    assert {r["model"]: r["w"] for r in weights.where("month_idx = 29").collect()} == {"a": 1.0, "b": 0.0}


def test_combining_a_month_without_weights_fails(spark):
    long = spark.createDataFrame([(1, "m1", "a", 2.0), (1, "m2", "a", 3.0)], "entity int, month string, model string, prediction double")
    weights = spark.createDataFrame([("m1", "a", 0.5)], "month string, model string, w double")
    assert rows(E.combine(long.where("month = 'm1'"), weights)) == [(1, "m1", 1.0)]
    with pytest.raises(Exception, match="no weight for a in month m2"):
        E.combine(long, weights).collect()


def test_expectations_fail_the_job(spark):
    returns = spark.createDataFrame([(1, m, 0.01) for m in range(1, 6)], "entity int, month_idx int, ret double")
    macro = spark.createDataFrame([(1, 0.0), (2, None), (3, 0.0), (4, 0.0), (5, 0.0)], "month_idx int, rf double")
    with pytest.raises(Exception, match="no rate for month 2"):
        H.forward_excess(returns, macro, 2).collect()
    blocks = [(1, b, m) for b, ms in (("train", (1, 2, 3)), ("validation", (4, 5)), ("test", (6,))) for m in ms]
    table = spark.createDataFrame(blocks, "window_id int, block string, month_idx int")
    assert sorted(r["month_idx"] for r in W.embargo(table, 1).collect()) == [1, 2, 4, 6]
    with pytest.raises(Exception, match="the embargo empties block validation of window 1"):
        W.embargo(table, 2).collect()


def test_journal(spark, tmp_path):
    path = str(tmp_path / "journal")
    assert G.read_table(spark, path).count() == 0
    one = spark.createDataFrame([("k1", "m", 0.5)], "key string, model string, r2_test double")
    G.append(spark, path, one)
    G.append(spark, path, one.unionByName(spark.createDataFrame([("k2", "m", 0.6)], one.schema)))
    got = G.read_table(spark, path)
    assert got.count() == 2 and "horizon" in got.columns
    assert [r["key"] for r in G.ranking(got).collect()] == ["k2", "k1"]
    assert G.snapshot({"a": 1}) == {"a": 1} and G.snapshot({}, horizon=12) == {"horizon": 12}
    assert G.label({"depth": [1, 2, 3, 4, 5, 6], "rate": 0.1}) == "depth=1..6 rate=0.1"


def test_measures_need_two_months(spark):
    df = spark.createDataFrame([("a", "200001", 0.1), ("b", "200001", -0.5), ("b", "200002", 0.1)], "portfolio string, month string, ret double")
    got = {r["portfolio"]: r for r in P.measures(df, p_value=True).collect()}
    assert got["a"]["sharpe"] is None and got["a"]["n_months"] == 1
    assert got["b"]["max_drawdown"] == 0  # a first-month loss is no drawdown


def test_manifest(spark, tmp_path):
    df = spark.createDataFrame([(None, 1.0), (2.0, 1.0)], "a double, b double")
    assert I.read_manifest(spark, str(tmp_path / "none"), ["a", "b"]) == ["a", "b"]
    I.write_manifest(I.select_by_null_rate(df, ["a", "b", "c"], 0.35), str(tmp_path / "manifest"))
    assert I.read_manifest(spark, str(tmp_path / "manifest"), ["a", "b"]) == ["b"]


def test_weight_table_falls_back_without_a_useful_score(spark):
    from panelspark.operators import ensemble as E

    months = spark.createDataFrame([("200001", 0), ("200002", 1)], "month string, month_idx int")
    scores = spark.createDataFrame([("a", -0.1), ("b", -0.2)], "model string, validation_r2 double")
    got = E.weight_table(months, scores, ["a", "b"], "validation_r2").collect()
    assert len(got) == 4 and all(r["fallback"] and r["w"] == 0.5 for r in got)
    assert E.fallback_counts(E.weight_table(months, scores, ["a", "b"], "equal")).first()["n_fallback"] == 0


def test_lost_significance(spark):
    from panelspark.operators import regressions as R

    table = lambda rows: spark.createDataFrame(rows, "portfolio string, factor_model string, t_alpha double")
    gross = table([("a", "CAPM", 2.5), ("b", "CAPM", 2.5), ("c", "CAPM", 1.0), ("d", "CAPM", 2.5)])
    net = table([("a", "CAPM", 1.0), ("b", "CAPM", 2.1), ("c", "CAPM", 0.5), ("d", "CAPM", None)])
    assert sorted(r["portfolio"] for r in R.lost_significance(gross, net).collect()) == ["a", "d"]


def test_no_variance_gives_null(spark):
    """Constant signals, errors that never vary, a total loss at the start, and one month: null, and the job goes on."""
    flat = spark.createDataFrame([(m, e, 1.0 if m == "a" else float(e), float(e * e % 7)) for m in "ab" for e in range(12)], "month string, entity int, s double, y double")
    ic = dict(rows(P.rank_ic(flat, "s", "y").select("month", "ic")))
    assert ic["a"] is None and -1 <= ic["b"] <= 1
    wide = spark.createDataFrame([(float(i), float(i), float(i * i), None if i == 3 else i / 2 + i % 2) for i in range(6)], "y double, a double, b double, c double")
    got = {(r[0], r[1]): r[2] for r in rows(E.error_correlation(wide, ["a", "b", "c"]))}
    assert got["a", "a"] is None and got["a", "b"] is None and got["b", "b"] == pytest.approx(1.0)
    some = [i for i in range(6) if i != 3]
    assert got["b", "c"] == pytest.approx(np.corrcoef([i - i * i for i in some], [i - i / 2 - i % 2 for i in some])[0, 1])
    lost = spark.createDataFrame([("p", "1", -1.0), ("p", "2", 0.5), ("q", "1", 0.5), ("q", "2", -1.0)], "portfolio string, month string, ret double")
    assert {r["portfolio"]: r["max_drawdown"] for r in P.measures(lost).collect()} == {"p": None, "q": -1.0}
    one = spark.createDataFrame([("x", 1, 0.5)], "predictor string, month_idx int, v double")
    for small in (True, False):
        r = R.newey_west(one, "v", small_sample=small).first()
        assert r["n"] == 1 and r["mean"] == 0.5 and r["t_stat"] is None


def test_elastic_net_from_sums_is_spark_mls(spark):
    """One scan for the whole grid against a fit over rows for each window and penalty."""
    from pyspark.ml.feature import VectorAssembler

    from panelspark.operators import penalised

    rng = random.Random(8)
    data = []
    for m in range(1, 37):
        for e in range(12):
            x = [rng.gauss(0, 1), rng.gauss(5, 3), rng.gauss(0, 0.2)]
            data.append((e, f"{2000 + (m - 1) // 12}{(m - 1) % 12 + 1:02d}", m, *x, None if e == 11 else 1.0, 0.5 * x[0] - 0.2 * x[1] + 0.3 * x[2] + rng.gauss(0, 1)))
    df = spark.createDataFrame(data, "entity int, month string, month_idx int, f1 double, f2 double, f3 double, f4 double, y double")
    table = W.windows(df, W.WindowPlan("expanding", 1, 1, 1))
    names, alphas, ratios = ["f1", "f2", "f3", "f4"], [0.0, 0.05, 0.3, 10.0], [0.0, 0.5, 1.0]
    path = penalised.elastic_net_path(df, table, names, "y", alphas, ratios)
    grid = {(r["alpha"], r["l1_ratio"]): r for r in path.grid.collect()}
    assert len(grid) == 12
    vector = VectorAssembler(inputCols=names, outputCol="features").transform(W.assign(df, table).na.drop()).withColumnRenamed("y", "label").persist()
    part = {b: vector.where(F.col("block") == b) for b in ("train", "validation", "test")}
    sd = part["train"].agg(F.stddev_pop("label")).first()[0]

    def spark_ml(a, ratio):
        """Spark ML divides the ridge part of the penalty by the label's deviation; undone here."""
        reg = a * ratio + a * (1 - ratio) * sd
        return M.elastic_net({"alpha": reg, "l1_ratio": a * ratio / reg if reg else 0.0}).setTol(1e-12).fit(part["train"])

    for (a, ratio), r in grid.items():
        model = spark_ml(a, ratio)
        for block in ("train", "validation"):
            assert r[f"r2_{block}"] == pytest.approx(M._score(model, part[block], "label")[0], abs=1e-6)
        assert r["n_used"] == sum(abs(c) > 1e-9 for c in model.coefficients)
    best = max(grid.values(), key=lambda r: r["r2_validation"])
    chosen = path.results.first()
    assert (chosen["alpha"], chosen["l1_ratio"]) == (best["alpha"], best["l1_ratio"]) and [k for k, r in grid.items() if r["selected"]] == [(best["alpha"], best["l1_ratio"])]
    model = spark_ml(best["alpha"], best["l1_ratio"])
    b = {r["predictor"]: r["coefficient"] for r in path.coefficients.collect()}
    assert [b[c] for c in ["intercept", *names]] == pytest.approx([model.intercept, *model.coefficients], abs=1e-6) and b["f4"] == 0.0
    assert chosen["r2_test"] == pytest.approx(M._score(model, part["test"], "label")[0], abs=1e-6)
    two = penalised.grid_by_two(path.grid, "alpha", "l1_ratio", ratios).collect()
    assert sorted(two[0].asDict()) == ["alpha", "l1_ratio_0.0", "l1_ratio_0.5", "l1_ratio_1.0", "rank"] and len(two) == 4
    nothing = penalised.elastic_net_path(df.limit(0), table, names, "y", alphas, ratios)
    assert nothing.grid.count() == nothing.results.count() == nothing.coefficients.count() == 0


def test_out_of_bag_and_split_counts(spark):
    """Rows scored by the trees that did not see them, one by one; splits as in the trees' text."""
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(9)
    data = [(e, "200001", 1, "train", x := rng.random(), rng.random(), float(x > 0.5) + rng.gauss(0, 0.1)) for e in range(120)]
    df = spark.createDataFrame(data, "entity int, month string, window_id int, block string, a double, b double, y double").coalesce(1)
    params, keys = {"depth": 2, "trees": 3}, ["entity", "month"]
    got = M.out_of_bag_r2(df, ["a", "b"], "y", params, keys).first()
    rows_in = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).withColumnRenamed("y", "label").persist()
    sums, labels = {}, {r["entity"]: r["label"] for r in rows_in.collect()}
    for tree in range(3):
        drawn = rows_in.withColumn("__w", M.bag_weight(tree, keys)).persist()
        model = M.bagged_tree(tree, params).fit(drawn.where("__w > 0"))
        for r in model.transform(drawn.where("__w = 0")).collect():
            sums.setdefault(r["entity"], []).append(r["prediction"])
        assert M.split_counts(model, 2) == [model.toDebugString.count(f"If (feature {i} ") for i in range(2)]
    want = 1 - sum((labels[e] - np.mean(p)) ** 2 for e, p in sums.items()) / sum(labels[e] ** 2 for e in sums)
    assert got["n_rows"] == 120 and got["n_scored"] == len(sums) < 120 and got["oob_r2"] == pytest.approx(want, abs=1e-9)
    weights = [r[0] for r in spark.range(20000).select(M.bag_weight(5, ["id"])).collect()]
    assert np.mean(weights) == pytest.approx(1, abs=0.03) and np.mean([w == 0 for w in weights]) == pytest.approx(math.exp(-1), abs=0.012)


def _fails(df, match):
    with pytest.raises(Exception, match=match):
        df.collect()


def test_empty_results_fail_when_read(spark):
    df = spark.createDataFrame([(i, "200001", float(i), 0.1, 0.0) for i in range(12)], "entity int, month string, s double, y double, cap double")
    _fails(P.long_only(df, "s", "y", 0.01), "fewer rows than a share")
    _fails(P.long_only(df, "s", "y", 0.5, weight="cap"), "positive cap")
    _fails(P.decile_returns(P.with_decile(df, "s"), "y", weight="cap"), "positive cap")
    assert rows(P.long_only(df, "s", "y", 0.1)) == [("200001", 0.1)]
    assert P.long_only(df, "s", "y", 0.01).columns == ["month", "ret"]  # nothing runs before


def test_macro_coverage(spark):
    macro = spark.createDataFrame([(m, 0.001) for m in (10, 11, 13)], "month_idx int, rf double")
    late = spark.createDataFrame([(1, 20, 0.1)], "entity int, month_idx int, ret double")
    _fails(H.restrict_to_macro(late, macro), "no return lies in the macro table's months")
    some = spark.createDataFrame([(1, 9, 0.1), (1, 10, 0.1), (1, 20, 0.1)], "entity int, month_idx int, ret double")
    assert rows(H.restrict_to_macro(some, macro)) == [(1, 10, 0.1)]
    assert rows(H.coverage(some, macro)) == [(3, 1, 1, 1)]
    gap = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.1), (1, 13, 0.1)], "entity int, month_idx int, ret double")
    _fails(H.forward_excess(gap, macro, 1), "no rate for month 12")


@pytest.mark.parametrize("weight", [None, "cap"])
def test_portfolios_of_one_job_equal_those_of_many(spark, weight):
    random.seed(8)  # an entity's return is the same in all portfolios
    data = [(m, e, f"{200000 + i}", i, random.random(), random.Random(100 * e + i).random() - 0.5, random.random()) for m in "ab" for i in range(1, 9) for e in range(30) if m == "a" or i > 2]
    df = spark.createDataFrame(data, "model string, entity int, month string, month_idx int, s double, ret double, cap double")
    jobs = {
        "monthly": lambda d, by: P.monthly_rebalance(d, "s", "ret", weight=weight, by=by),
        "cohorts": lambda d, by: P.cohorts(d, "s", "ret", 3, weight=weight, by=by),
        "annual": lambda d, by: P.annual_rebalance(d, "s", "ret", 3, weight=weight, by=by),
        "gaps": lambda d, by: P.construction_gaps(P.compare_constructions(d, "s", "ret", "cap", 0.2, by=by), within=by),
        "costs": lambda d, by: C.long_short_with_costs(P.with_decile(d, "s", by=[*by, "month"]), 10, 100, weight=weight, by=by).drop("r"),
    }
    tidy = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect())
    for name, job in jobs.items():
        together = job(df, ["model"])
        alone = [job(df.where(F.col("model") == m).drop("model"), []).withColumn("model", F.lit(m)) for m in "ab"]
        assert tidy(together) == tidy(alone[0].unionByName(alone[1]).select(*together.columns)), name


def test_two_writers_leave_one_row_a_key(spark, tmp_path, monkeypatch):
    """The second writer commits between the first one's read and its commit."""
    path, schema = str(tmp_path / "journal"), "key string, model string"
    batch = lambda model, *ks: spark.createDataFrame([(k, model) for k in ks], schema)
    real, calls = I.append_new, []

    def slow(existing, fresh, on):
        calls.append(len(calls))
        out = spark.createDataFrame(real(existing, fresh, on).collect(), fresh.schema)
        if len(calls) == 1:
            G.append(spark, path, batch("second", "b", "c"))
        return out

    monkeypatch.setattr(G, "append_new", slow)
    G.append(spark, path, batch("first", "a", "b"))
    assert len(calls) == 3  # the first writer made its rows twice
    assert sorted(rows(G.read_table(spark, path).select("key", "model"))) == [("a", "first"), ("b", "second"), ("c", "second")]
    assert sorted(p.name for p in (tmp_path / "journal").iterdir()) == ["batch-000000001", "batch-000000002"]
    with pytest.raises(RuntimeError, match="came first"):
        I.append_batch(spark, path, lambda: (I.append_batch(spark, path, lambda: batch("x", "x")), batch("y", "y"))[1], attempts=2)


def test_grid_by_two_parameters(spark):
    data = [(w, d, leaf, w + 10 * d + leaf) for w in (1, 2) for d in (2, 4) for leaf in (1, 20)]
    tried = spark.createDataFrame([(w, {"depth": str(d), "leaf": str(leaf)}, float(s)) for w, d, leaf, s in data] + [(1, {"depth": "4"}, 999.0)], "window_id int, axes map<string,string>, r2_validation double")
    got = {r["depth"]: r.asDict() for r in M.axis_table(tried, "depth", "leaf", [1, 20]).collect()}
    assert got["2"] == {"depth": "2", "leaf_1": 22.5, "leaf_20": 41.5, "rank": 2} and got["4"]["leaf_20"] == 61.5 and got["4"]["rank"] == 1


def test_source_profiles_of_empty_and_null(spark):
    some = spark.createDataFrame([(1, "200001", None), (None, "200002", 2.0)], "entity int, month string, x double")
    sources = {"some": some, "none": some.limit(0), "months": some.select("month")}
    got = {r["source"]: tuple(r)[1:] for r in I.source_profiles(sources).collect()}
    assert got == {"some": (3, 2, 1, 2, "200001", "200002", 0.5), "none": (3, 0, 0, 0, None, None, None), "months": (1, 2, None, 2, "200001", "200002", None)}
    assert rows(I.source_overlap({"some": some, "none": some.limit(0)}, "entity")) == [("some", "none", 1, 0, 0)]
    assert rows(I.source_overlap({"a": some.limit(0), "b": some.limit(0)}, "entity")) == [("a", "b", 0, 0, 0)]


@pytest.fixture
def small_tasks(monkeypatch):
    from panelspark.sources import scratch

    monkeypatch.setattr(scratch, "TASK_BYTES", 1 << 10)


def test_cross_sections_larger_than_a_task(spark, tmp_path, small_tasks):
    data = [(f"m{i % 2}", i, None if i % 17 == 0 else float((i * 7919 % 1000) // 3), (i * 31 % 97) / 7 if i % 5 else -0.0) for i in range(3000)]
    spark.createDataFrame([*data, ("m2", 1, None, 1.0)], "month string, entity long, s double, y double").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    lines = lambda d: sorted(repr(r) for r in rows(d))
    assert lines(X.deciles(df, "s")) == lines(df.withColumn("decile", X.decile("s")))
    old = df.withColumn("s_rank", X.average_rank("s", ["month"])).withColumn("y_rank", X.average_rank("y", ["month"]))
    ranked = X.average_ranks(df, ["s", "y"], ["month"])
    assert lines(ranked.select(old.columns)) == lines(old)
    at = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    got = {r["month"]: r["__q"] for r in X.group_quantiles(df, "s", at, ["month"]).collect()}
    want = {r["month"]: r["q"] for r in df.groupBy("month").agg(X.quantiles("s", at).alias("q")).collect()}
    assert got == {k: q for k, q in want.items() if q is not None} and set(want) - set(got) == {"m2"}
    # one month lies in several tasks, and nothing but rows of one value meets in a window
    assert X.written(X._in_order(df, ["month", "s", "entity"]), "t").where("month = 'm0'").select(F.shiftright("__at", 33)).distinct().count() > 1


def test_cohort_rows_are_not_broadcast(spark, tmp_path):
    spark.range(4000).selectExpr("id % 100 as entity", "cast(id / 100 as int) + 24000 as month_idx", "cast(cast(id / 100 as int) + 24000 as string) as month", "rand(1) as s", "rand(2) as ret").write.parquet(str(tmp_path / "rows"))
    held = P.cohort_positions(spark.read.parquet(str(tmp_path / "rows")), "s", "ret", 6)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [entity" in plan


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_high_session_numbers_are_not_merged_into_large_tasks(spark, tmp_path, small_tasks, many_partitions):
    """Adaptive execution merged 200 partitions into one here, and into tasks of 64 MB of compressed rows on large tables."""
    from panelspark.sources.scratch import parts, spread

    data = [(f"m{i % 2}", i, float(i * 7919 % 1000)) for i in range(5000)]
    spark.createDataFrame(data, "month string, entity long, s double").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    n = parts(df)
    assert 4 < n < 200
    assert X.written(X._in_order(df, ["s", "entity"]), "t").select(F.shiftright("__at", 33)).distinct().count() == n
    assert X.written(spread(df, "entity").groupBy("entity").count().withColumn("t", F.spark_partition_id()), "t").select("t").distinct().count() == n


def test_described_groups_come_from_sums_by_month(spark):
    data = [("a", 1, "m1", 1.0), ("a", 2, "m1", 3.0), ("a", 1, "m2", None), ("b", 3, "m2", 4.0), ("b", 3, None, None), (None, 4, "m1", 9.0)]
    df = spark.createDataFrame([(e, m, g, c) for g, e, m, c in data], "entity long, month string, size_group string, cap double")
    out = P.describe_groups(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 4  # the rows themselves once, for distinct entities
    assert sorted(rows(out)) == [("a", 3, 2, 2, 1.5, 1, 2, 1.0, 1.5, 2.0, 2.0, 2.5, 3.0, 0.5), ("b", 2, 1, 1, 1.0, 1, 1, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 0.5)]


def test_ranks_keep_their_tasks_under_high_session_numbers(spark, tmp_path, small_tasks, many_partitions):
    data = [("a", f"m{i % 2}", float(i * 7919 % 1000), (i * 31 % 97) / 7) for i in range(5000)]
    spark.createDataFrame(data, "model string, month string, s double, y double").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    ranked = X.average_ranks(df, ["s", "y"], ["model", "month"])
    assert len([f for f in ranked.inputFiles() if "/ranked-" in f]) > 4  # one file of all rows before
    old = df.withColumn("s_rank", X.average_rank("s", ["month"])).withColumn("y_rank", X.average_rank("y", ["month"]))
    assert sorted(rows(ranked.select(old.columns))) == sorted(rows(old))
