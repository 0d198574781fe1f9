"""Spark ML models over walk-forward windows: grids, staged search, selection, importances."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.windows import r2_zero
from panelspark.sources.scratch import discard, new_place

Params = Mapping[str, float | int | str]


def grid(**axes: Sequence) -> list[dict]:
    """All combinations, in declared order."""
    return [dict(zip(axes, values)) for values in itertools.product(*axes.values())]


def linear(params: Params) -> LinearRegression:
    return LinearRegression(solver="normal", regParam=0.0)


def elastic_net(params: Params) -> LinearRegression:
    """The penalty is on the features as they are, without scaling.

    Spark ML divides the ridge part by the target's deviation; ``penalised`` does not.
    """
    return LinearRegression(regParam=params["alpha"], elasticNetParam=params["l1_ratio"], maxIter=1000, standardization=False)


def forest(params: Params) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=params.get("trees", 20), maxDepth=params.get("depth", 5), minInstancesPerNode=params.get("leaf", 1), featureSubsetStrategy=str(params.get("features", "onethird")), seed=0)


def boosting(params: Params) -> GBTRegressor:
    """Depth-wise trees; the best number of them is chosen on the validation rows."""
    return GBTRegressor(maxIter=params.get("trees", 20), maxDepth=params.get("depth", 3), stepSize=params.get("rate", 0.1), minInstancesPerNode=params.get("leaf", 1), subsamplingRate=0.7, featureSubsetStrategy="0.7", seed=0)


@dataclass
class Spec:
    """A model: how to make it, its grid, and stages of further combinations from the best so far."""

    name: str
    make: Callable[[Params], object]
    combos: list[dict]
    stages: list[Callable[[dict], list[dict]]] = field(default_factory=list)


@dataclass
class Trained:
    predictions: DataFrame
    grid: DataFrame
    results: DataFrame
    weights: DataFrame
    pipeline: PipelineModel | None


def _score(model, rows: DataFrame, target: str) -> tuple[float | None, int]:
    r = model.transform(rows).agg(r2_zero(target, "prediction").alias("r2"), F.count(F.lit(1)).alias("n")).first()
    return r["r2"], r["n"]


@dataclass
class _Fit:
    """A combination's model with its scores; of boosted trees, those of the first ``trees``."""

    params: Params
    model: object
    trees: int | None
    at_budget: bool | None
    at_depth: bool | None
    r2: dict[str, float | None]


def _fit(spec: Spec, params: Params, block: dict[str, DataFrame], size: dict[str, tuple[int, float]]) -> _Fit:
    maker = spec.make(params)
    model = maker.fit(block["train"])
    if not isinstance(maker, GBTRegressor):
        at_depth = max(t.depth for t in model.trees) == maker.getMaxDepth() if hasattr(model, "trees") else None
        return _Fit(params, model, None, None, at_depth, {b: _score(model, block[b], "label")[0] for b in ("train", "validation")})
    # errors of every number of trees, in one pass a block: the best number is known without another fit
    errors = {b: model.evaluateEachIteration(block[b], "squared") if size[b][0] else None for b in ("train", "validation")}
    by = errors["validation"] or errors["train"]
    trees = min(range(len(by)), key=by.__getitem__) + 1
    r2 = {b: 1 - e[trees - 1] * size[b][0] / size[b][1] if e and size[b][1] else None for b, e in errors.items()}
    return _Fit(params, model, trees, trees == maker.getMaxIter(), max(t.depth for t in model.trees[:trees]) == maker.getMaxDepth(), r2)


def train(spec: Spec, rows: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = ("entity", "month"), threads: int = 4) -> Trained:
    """Walk-forward training over ``rows`` (with ``window_id`` and ``block``).

    Per window every combination is fitted on the training rows, ``threads`` at a
    time; the highest validation R2 wins, over all stages, ties to the first, and
    predicts the test rows once.  Boosted trees are scored at the best number of them
    on the validation rows; only the winner is fitted again with that many.  Fits are
    Spark jobs over the window's rows; the driver holds scores only.  Rows with a
    null feature or target are left out; a window in which no combination has a
    validation score fails the job.
    """
    spark = rows.sparkSession
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    data = assembler.transform(rows.na.drop(subset=[*features, target])).withColumnRenamed(target, "label")
    ids = sorted(r["window_id"] for r in rows.select("window_id").distinct().collect())  # a dozen windows
    predicted, tried, results, weights, pipeline = None, [], [], [], None
    for window in ids:
        own = data.where(F.col("window_id") == window).persist()
        block = {b: own.where(F.col("block") == b) for b in ("train", "validation", "test")}
        size = {r["block"]: (r["n"], r["yy"]) for r in own.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label") ** 2).alias("yy")).collect()}
        size = {b: size.get(b, (0, 0.0)) for b in block}
        best, best_stage = None, 0
        for stage, combos in enumerate([spec.combos, *spec.stages]):
            some = combos(best.params) if callable(combos) else combos
            with ThreadPoolExecutor(threads) as pool:
                done = list(pool.map(inheritable_thread_target(spark)(lambda p: _fit(spec, p, block, size)), some))  # noqa: B023
            for one in done:
                tried.append((window, stage, str(one.params), {k: str(v) for k, v in one.params.items()}, one.trees, one.at_budget, one.at_depth, one.r2["train"], one.r2["validation"]))
                if one.r2["validation"] is not None and (best is None or one.r2["validation"] > best.r2["validation"]):
                    best, best_stage = one, stage
        if best is None:
            raise ValueError(f"no combination has a validation score in window {window}")
        model = best.model
        if best.trees and not best.at_budget:  # a tree depends on its place and the seed, so these are the same first trees
            model = spec.make(best.params).setMaxIter(best.trees).fit(block["train"])
        test_r2, _ = _score(model, block["test"], "label")
        results.append((window, str(best.params), best_stage, best.trees, size["train"][0], best.r2["train"], best.r2["validation"], test_r2))
        values = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
        splits = split_counts(model, len(features)) if hasattr(model, "trees") else [None] * len(features)
        weights += [(window, f, float(v), n) for f, v, n in zip(features, values.toArray(), splits)]
        part = model.transform(data.where((F.col("window_id") == window) & (F.col("block") == "test"))).select(*keys, F.col("label").alias(target), "prediction", "window_id").withColumn("model", F.lit(spec.name))
        predicted = part if predicted is None else predicted.unionByName(part)
        pipeline = PipelineModel([assembler, model])
        own.unpersist()
    table = lambda r, s: spark.createDataFrame(r, s)
    tried_df = table(tried, "window_id int, stage int, params string, axes map<string,string>, best_trees int, at_budget boolean, at_depth boolean, r2_train double, r2_validation double")
    out = table(results, "window_id int, params string, stage int, best_trees int, n_train long, r2_train double, r2_validation double, r2_test double")
    chosen = tried_df.join(F.broadcast(out.select("window_id", "params", F.lit(True).alias("selected"))), ["window_id", "params"], "left").withColumn("selected", F.coalesce("selected", F.lit(False))).withColumn("gap", F.col("r2_train") - F.col("r2_validation"))
    return Trained(predicted, chosen, out, table(weights, "window_id int, predictor string, coefficient double, splits long"), pipeline)


def split_counts(model, n_features: int) -> list[int]:
    """How many nodes of an ensemble of trees split on each feature, from the table of nodes that the model is stored as."""
    spark = SparkSession.active()
    path = new_place(spark, "trees")
    model.write().save(path)
    nodes = spark.read.load(f"{path}/data").select("nodeData.leftChild", "nodeData.split.featureIndex")
    found = dict(nodes.where("leftChild >= 0").groupBy("featureIndex").count().collect())
    discard(spark, path)
    return [found.get(i, 0) for i in range(n_features)]


def save_model(pipeline: PipelineModel, path: str) -> None:
    """Stores features and model of the last window; an earlier model at that place goes."""
    pipeline.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A stored model; its ``transform`` takes rows with the features' columns and adds ``prediction``."""
    return PipelineModel.load(path)


def grid_summary(tried: DataFrame) -> DataFrame:
    """Per combination: mean scores, gap, times selected, and ranks by validation and by gap."""
    from pyspark.sql.window import Window

    one = tried.groupBy("params").agg(F.avg("r2_train").alias("r2_train"), F.avg("r2_validation").alias("r2_validation"), F.avg("gap").alias("gap"), F.count_if("selected").alias("n_selected"))
    return one.withColumn("rank_validation", F.rank().over(Window.orderBy(F.desc("r2_validation")))).withColumn("rank_gap", F.rank().over(Window.orderBy("gap")))


def axis_table(tried: DataFrame, row: str, column: str, values: Sequence, score: str = "r2_validation") -> DataFrame:
    """Mean score over windows and all other parameters: a row for each value of ``row``, a column for each of ``values`` of
    ``column``, and the row's rank by its best.  Parameter values are texts; combinations without either parameter do not count."""
    from panelspark.operators.penalised import grid_by_two

    both = tried.withColumns({a: F.try_element_at("axes", F.lit(a)) for a in (row, column)})
    return grid_by_two(both.na.drop(subset=[row, column]), row, column, [str(v) for v in values], score)


def search_diagnostics(tried: DataFrame, results: DataFrame) -> DataFrame:
    """Percent of windows that a later stage won, mean number of combinations a window, and percent of combinations
    whose best number of trees is all that were allowed, or whose trees reach the depth allowed (null without trees)."""
    won = results.agg((100 * F.avg((F.col("stage") > 0).cast("double"))).alias("pct_later_stage"))
    n = tried.groupBy("window_id").count().agg(F.avg("count").alias("mean_combinations"))
    pct = lambda c: 100 * F.avg(F.col(c).cast("double"))
    return won.crossJoin(n).crossJoin(tried.agg(pct("at_budget").alias("pct_at_budget"), pct("at_depth").alias("pct_at_depth")))


def importance_table(weights: DataFrame) -> DataFrame:
    """Importances scaled to 100 a window: mean, deviation, mean rank, percent of windows without use, mean number of splits
    (null where splits are not counted).

    A window in which nothing was used has no shares.
    """
    from pyspark.sql.window import Window

    from panelspark.operators.xsection import average_rank

    if "splits" not in weights.columns:
        weights = weights.withColumn("splits", F.lit(None).cast("long"))
    share = 100 * F.try_divide("coefficient", F.sum("coefficient").over(Window.partitionBy("window_id")))
    rows = weights.withColumn("share", share).withColumn("place", average_rank("share", ["window_id"], descending=True))
    return rows.groupBy("predictor").agg(F.avg("share").alias("mean_share"), F.stddev_samp("share").alias("sd_share"), F.avg("place").alias("mean_rank"), (100 * F.avg((F.col("coefficient") == 0).cast("double"))).alias("pct_unused"), F.avg("splits").alias("mean_splits"))


def bag_weight(tree: int, keys: Sequence[str]) -> Column:
    """How often a row is in a tree's bag: Poisson with mean 1, drawn by a hash of the row's key and the tree.

    Every row's bags are known without storing them, on any machine.
    """
    u = F.pmod(F.xxhash64(F.lit(tree), *keys), F.lit(1 << 32)) / float(1 << 32)
    out, p, below = F.lit(9.0), math.exp(-1), []
    total = 0.0
    for k in range(9):
        total += p
        below.append((total, float(k)))
        p /= k + 1
    for bound, k in reversed(below):
        out = F.when(u < bound, F.lit(k)).otherwise(out)
    return out


def bagged_tree(tree: int, params: Params) -> RandomForestRegressor:
    """One tree of a forest, fitted on the rows of its bag with their weights."""
    return forest(params).setNumTrees(1).setBootstrap(False).setSeed(tree).setWeightCol("__w")


#: Trees whose predictions are added up before the sums are written.
TREES_A_PASS = 24


def out_of_bag_r2(rows: DataFrame, features: Sequence[str], target: str, params: Params, keys: Sequence[str] = ("entity", "month")) -> DataFrame:
    """``window_id, oob_r2, n_rows, n_scored``: training rows of every window, each scored by the mean of the trees that did not see it.

    Trees are fitted on bags (:func:`bag_weight`), one after the other; rows that
    all trees saw are not scored, and rows with a null are left out.
    """
    spark, trees = rows.sparkSession, params.get("trees", 20)
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows.where("block = 'train'").na.drop(subset=[*features, target])).select("window_id", *keys, "features", F.col(target).alias("label"))
    out = []
    for window in sorted(r["window_id"] for r in data.select("window_id").distinct().collect()):  # a dozen windows
        own = data.where(F.col("window_id") == window).persist()
        scored, places = own.withColumn("__sum", F.lit(0.0)).withColumn("__n", F.lit(0)), []
        for tree in range(trees):
            weight = bag_weight(tree, keys)
            model = bagged_tree(tree, params).fit(own.withColumn("__w", weight).where("__w > 0"))
            free = weight == 0
            scored = model.setPredictionCol("__p").transform(scored).withColumn("__sum", F.col("__sum") + F.when(free, F.col("__p")).otherwise(0.0)).withColumn("__n", F.col("__n") + free.cast("int")).drop("__p")
            if tree % TREES_A_PASS == TREES_A_PASS - 1:
                places.append(new_place(spark, "bags"))
                scored.write.parquet(places[-1])
                scored = spark.read.schema(scored.schema).parquet(places[-1])
        score = scored.withColumn("prediction", F.try_divide("__sum", "__n"))
        r = score.where("__n > 0").agg(r2_zero("label", "prediction").alias("r2"), F.count(F.lit(1)).alias("n")).first()
        out.append((window, r["r2"], own.count(), r["n"]))
        own.unpersist()
        discard(spark, *places)
    return spark.createDataFrame(out, "window_id int, oob_r2 double, n_rows long, n_scored long")
