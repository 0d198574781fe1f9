"""Registered queries: Spark ML models, and the record of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import journal as G
from panelspark.operators import models as M
from panelspark.operators import penalised as N
from panelspark.operators import windows as W
from panelspark.plans.registry import query
from panelspark.sources import testpanel as T
from panelspark.sources.scratch import new_place

FEATURES = ["f2", "f3"]


def _rows(s: SparkSession, d: str) -> DataFrame:
    p = T.panel(s, d, "l_suppkey").withColumn("y", F.col("ret") - F.col("rf"))
    return W.assign(p, W.windows(p, W.WindowPlan("rolling", 4, 1, 1)))


@query("ml_linear")
def ml_linear(s, d):
    return M.train(M.Spec("linear", M.linear, [{}]), _rows(s, d), FEATURES, "y").results


@query("ml_elastic_net")
def ml_elastic_net(s, d):
    spec = M.Spec("elastic_net", M.elastic_net, M.grid(alpha=[1e-4, 1e-2], l1_ratio=[0.5]))
    return M.grid_summary(M.train(spec, _rows(s, d), FEATURES, "y").grid)


ALPHAS, RATIOS = [1e-4, 1e-3, 1e-2], [0.5, 1.0]
_BLOCKS = "SELECT window_id, block, count(*) AS n, sum(f3) AS x, sum(y) AS y, sum(f3 * f3) AS xx, sum(f3 * y) AS xy, sum(y * y) AS yy FROM ex JOIN win USING (month) WHERE f3 IS NOT NULL GROUP BY 1, 2"
_NET = f"""SELECT window_id, alpha, l1_ratio, b, sy - b * sx AS a, n FROM (SELECT t.*, p.*, x / n AS sx, y / n AS sy,
  sign(xy / n - x / n * y / n) * greatest(abs(xy / n - x / n * y / n) - alpha * l1_ratio, 0) / (xx / n - (x / n) ** 2 + alpha * (1 - l1_ratio)) AS b
 FROM ({_BLOCKS}) t, (SELECT alpha, l1_ratio FROM (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALPHAS)}) AS u(alpha), (VALUES {', '.join(f'({r}::DOUBLE)' for r in RATIOS)}) AS v(l1_ratio)) p WHERE block = 'train')"""
_R2 = lambda k: f"1 - ({k}.yy - 2 * (m.a * {k}.y + m.b * {k}.xy) + m.a ** 2 * {k}.n + 2 * m.a * m.b * {k}.x + m.b ** 2 * {k}.xx) / {k}.yy"
_NETS = f"""SELECT m.window_id, m.alpha, m.l1_ratio, CASE WHEN m.b <> 0 THEN 1 ELSE 0 END AS n_used, m.a, m.b, t.n AS n_train, {_R2('t')} AS r2_train, {_R2('v')} AS r2_validation, {_R2('s')} AS r2_test
 FROM ({_NET}) m JOIN ({_BLOCKS}) t ON t.window_id = m.window_id AND t.block = 'train' LEFT JOIN ({_BLOCKS}) v ON v.window_id = m.window_id AND v.block = 'validation' LEFT JOIN ({_BLOCKS}) s ON s.window_id = m.window_id AND s.block = 'test'"""


def _net(s: SparkSession, d: str, names: list[str]) -> N.Path:
    p = T.panel(s, d).withColumn("y", F.col("ret") - F.col("rf"))
    return N.elastic_net_path(p, W.windows(p, W.WindowPlan("rolling", 3, 2, 1, 1, 2, 1)), names, "y", ALPHAS, RATIOS)


@query("ml_elastic_net_one", f"SELECT window_id, alpha, l1_ratio, n_used, r2_train, r2_validation, r2_train - r2_validation AS gap, row_number() OVER (PARTITION BY window_id ORDER BY r2_validation DESC NULLS LAST, alpha, l1_ratio) = 1 AS selected FROM ({_NETS})", "r2_train r2_validation gap")
def ml_elastic_net_one(s, d):
    """All windows and penalties of one predictor, whose solution is a soft threshold in SQL."""
    return _net(s, d, ["f3"]).grid


@query("ml_elastic_net_windows", f"SELECT window_id, alpha, l1_ratio, n_train, n_used, r2_train, r2_validation, r2_test FROM ({_NETS}) QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY r2_validation DESC NULLS LAST, alpha, l1_ratio) = 1", "r2_train r2_validation r2_test")
def ml_elastic_net_windows(s, d):
    return _net(s, d, ["f3"]).results


@query("ml_elastic_net_coefficients", f"SELECT window_id, unnest(['intercept', 'f3']) AS predictor, unnest([a, b]) AS coefficient FROM (SELECT * FROM ({_NETS}) QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY r2_validation DESC NULLS LAST, alpha, l1_ratio) = 1)", "coefficient")
def ml_elastic_net_coefficients(s, d):
    return _net(s, d, ["f3"]).coefficients


@query("ml_elastic_net_path")
def ml_elastic_net_path(s, d):
    """All windows and penalties of three predictors, from one scan."""
    return _net(s, d, ["f1", "f2", "f3"]).grid


@query("ml_elastic_net_by_two", f"SELECT *, rank() OVER (ORDER BY greatest(\"l1_ratio_0.5\", \"l1_ratio_1.0\") DESC NULLS LAST) AS rank FROM (SELECT alpha, avg(r2_validation) FILTER (l1_ratio = 0.5) AS \"l1_ratio_0.5\", avg(r2_validation) FILTER (l1_ratio = 1) AS \"l1_ratio_1.0\" FROM ({_NETS}) GROUP BY 1)", '"l1_ratio_0.5" "l1_ratio_1.0"')
def ml_elastic_net_by_two(s, d):
    """The grid by its two axes."""
    return N.grid_by_two(_net(s, d, ["f3"]).grid, "alpha", "l1_ratio", RATIOS)


@query("ml_forest")
def ml_forest(s, d):
    spec = M.Spec("forest", M.forest, M.grid(depth=[3], trees=[8]), [lambda best: [best | {"leaf": 20}]])
    return M.importance_table(M.train(spec, _rows(s, d), FEATURES, "y").weights)


@query("ml_forest_by_two")
def ml_forest_by_two(s, d):
    """The forest's grid by depth and leaf size."""
    spec = M.Spec("forest", M.forest, M.grid(depth=[2, 4], leaf=[1, 50], trees=[4]))
    return M.axis_table(M.train(spec, _rows(s, d), FEATURES, "y").grid, "depth", "leaf", [1, 50])


@query("ml_boosting")
def ml_boosting(s, d):
    return M.train(M.Spec("boosting", M.boosting, M.grid(depth=[2], trees=[6])), _rows(s, d), FEATURES, "y").predictions


@query("ml_search_diagnostics")
def ml_search_diagnostics(s, d):
    spec = M.Spec("boosting", M.boosting, M.grid(depth=[2], trees=[4]), [lambda best: [best | {"rate": 0.3}]])
    done = M.train(spec, _rows(s, d), FEATURES, "y")
    return M.search_diagnostics(done.grid, done.results)


@query("ml_boosting_importances")
def ml_boosting_importances(s, d):
    """Mean gain, mean splits and percent unused of each predictor over all windows."""
    return M.importance_table(M.train(M.Spec("boosting", M.boosting, M.grid(depth=[2], trees=[6])), _rows(s, d), FEATURES, "y").weights)


@query("ml_out_of_bag")
def ml_out_of_bag(s, d):
    """Every window's training rows, scored by the trees that did not see them."""
    return M.out_of_bag_r2(_rows(s, d), FEATURES, "y", {"depth": 3, "trees": 8})


_FIT = "SELECT window_id, regr_slope(y, f3) AS b, regr_intercept(y, f3) AS a FROM ex JOIN win USING (month) WHERE block = 'train' GROUP BY 1"
_LINEAR_R2 = ", ".join(f"1 - sum((y - a - b * f3) ** 2) FILTER (block = '{k}') / sum(y ** 2) FILTER (block = '{k}') AS r2_{k}" for k in ("train", "validation", "test"))


def _linear(s: SparkSession, d: str) -> tuple[DataFrame, M.Trained]:
    p = T.panel(s, d).withColumn("y", F.col("ret") - F.col("rf"))
    rows = W.assign(p, W.windows(p, W.WindowPlan("rolling", 3, 2, 1, 1, 2, 1)))
    return rows, M.train(M.Spec("linear", M.linear, [{}]), rows, ["f3"], "y")


@query("ml_model_sink", f"SELECT entity, month, a + b * f3 AS prediction FROM ex JOIN win USING (month) JOIN ({_FIT}) USING (window_id) WHERE block = 'test' AND window_id = (SELECT max(window_id) FROM win) AND f3 IS NOT NULL", "prediction", digits=9)
def ml_model_sink(s, d):
    """The last window's model, stored twice at one place, read back and applied to that window's test rows."""
    rows, done = _linear(s, d)
    path = new_place(s, "model")
    for _ in range(2):
        M.save_model(done.pipeline, path)
    last = rows.where(F.col("block") == "test").crossJoin(F.broadcast(rows.agg(F.max("window_id").alias("__last")))).where("window_id = __last and f3 is not null")
    return M.load_model(path).transform(last).select("entity", "month", "prediction")


@query("ml_linear_one", f"SELECT window_id, count(*) FILTER (block = 'train') AS n_train, {_LINEAR_R2} FROM ex JOIN win USING (month) JOIN ({_FIT}) USING (window_id) WHERE f3 IS NOT NULL GROUP BY 1", "r2_train r2_validation r2_test")
def ml_linear_one(s, d):
    """The walk-forward loop with one predictor, whose fits SQL can express."""
    return _linear(s, d)[1].results.select("window_id", "n_train", "r2_train", "r2_validation", "r2_test")


@query("ml_linear_predictions", f"SELECT entity, month, window_id, y, a + b * f3 AS prediction, 'linear' AS model FROM ex JOIN win USING (month) JOIN ({_FIT}) USING (window_id) WHERE block = 'test' AND f3 IS NOT NULL", "y prediction", digits=9)
def ml_linear_predictions(s, d):
    return _linear(s, d)[1].predictions


def _runs(s: SparkSession, d: str) -> DataFrame:
    """A journal made of orders: customers as keys, priorities as models."""
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select(
        F.concat(F.col("o_custkey").cast("string"), F.lit("|"), F.col("o_orderstatus")).alias("key"), F.col("o_orderdate").cast("timestamp").alias("logged_at"), F.col("o_orderpriority").alias("model"),
        F.col("o_orderstatus").alias("label"), (F.col("o_orderkey") % 97).cast("double").alias("r2_test"), F.col("o_totalprice").cast("double").alias("duration_s"), "o_orderkey",
    )


_RUNS = "SELECT CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus AS key, o_orderdate AS logged_at, o_orderpriority AS model, o_orderstatus AS label, CAST(o_orderkey % 97 AS DOUBLE) AS r2_test, CAST(o_totalprice AS DOUBLE) AS duration_s, o_orderkey FROM orders"


@query("jr_experiment_key", f"SELECT o_orderkey, substring(sha256('{{\"key\": \"' || key || '\"}}'), 1, 16) AS experiment FROM ({_RUNS})", panel=None)
def jr_experiment_key(s, d):
    return _runs(s, d).select("o_orderkey", G.experiment_key(F.concat(F.lit('{"key": "'), "key", F.lit('"}'))).alias("experiment"))


@query("jr_ensemble_key", f"SELECT model, substring(sha256(string_agg(k, ',' ORDER BY k) || '|' || '{{}}'), 1, 16) AS experiment FROM (SELECT DISTINCT model, label AS k FROM ({_RUNS})) GROUP BY 1", panel=None)
def jr_ensemble_key(s, d):
    return _runs(s, d).groupBy("model").agg(G.ensemble_key(F.collect_set("label"), F.lit("{}")).alias("experiment"))


@query("jr_latest", f"SELECT key, strftime(max(logged_at), '%Y-%m-%d') AS logged_at FROM ({_RUNS}) GROUP BY 1", panel=None)
def jr_latest(s, d):
    return G.latest(_runs(s, d)).select("key", F.date_format("logged_at", "yyyy-MM-dd").alias("logged_at"))


@query("jr_ranking", f"SELECT o_orderkey, r2_test, row_number() OVER (PARTITION BY model ORDER BY r2_test DESC, o_orderkey) = 1 AS best_of_model FROM ({_RUNS})", "r2_test", None)
def jr_ranking(s, d):
    return G.ranking(_runs(s, d).withColumn("key", F.col("o_orderkey"))).select("o_orderkey", "r2_test", "best_of_model")


@query("jr_varied", f"SELECT 'model' AS parameter, count(DISTINCT model) AS n_values FROM ({_RUNS}) UNION ALL SELECT 'label', count(DISTINCT label) FROM ({_RUNS})", panel=None)
def jr_varied(s, d):
    return G.varied(_runs(s, d).withColumn("one", F.lit(1)), ["model", "label", "one"])


@query("jr_run_counts", f"SELECT model, label, count(*) AS n_runs, avg(duration_s) AS mean_duration_s, max(r2_test) AS best_r2_test FROM ({_RUNS}) GROUP BY 1, 2", "mean_duration_s best_r2_test", None)
def jr_run_counts(s, d):
    return G.run_counts(_runs(s, d))


@query("jr_model_tables", f"SELECT j.o_orderkey, h.sharpe, row_number() OVER (PARTITION BY model, label ORDER BY r2_test DESC, j.o_orderkey) AS place FROM ({_RUNS}) j LEFT JOIN (SELECT o_orderkey, r2_test / 2 AS sharpe FROM ({_RUNS}) WHERE o_orderkey % 2 = 0) h ON j.o_orderkey = h.o_orderkey", "sharpe", None)
def jr_model_tables(s, d):
    runs = _runs(s, d).withColumn("key", F.col("o_orderkey"))
    history = runs.where("o_orderkey % 2 = 0").select("key", "logged_at", (F.col("r2_test") / 2).alias("sharpe"), F.lit(0.0).alias("mean_annual"))
    return G.model_tables(runs, history).select("o_orderkey", "sharpe", "place")
