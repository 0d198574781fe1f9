"""Elastic net over walk-forward windows from monthly sums: every window and penalty from one scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.operators.ensemble import gram, gram_names

#: Sweeps over the coefficients, and the change in a fitted value's deviation at which they end.
MOST_SWEEPS, TOLERANCE = 1000, 1e-10


def coordinate_descent(xx: np.ndarray, xy: np.ndarray, n: float, alpha: float, l1_ratio: float) -> np.ndarray:
    """Intercept and coefficients of least (1 / 2n) squared error + alpha (l1_ratio |b| + (1 - l1_ratio) b^2 / 2), from sums.

    ``xx, xy``: cross products with a constant 1 first, which is not penalised.  A
    coefficient at a time is soft-thresholded, given all others, on the centred sums.
    A predictor that never varies gets 0.
    """
    mean, mean_y = xx[0, 1:] / n, xy[0] / n
    s, c = xx[1:, 1:] / n - np.outer(mean, mean), xy[1:] / n - mean * mean_y
    scale = np.sqrt(np.maximum(np.diag(s), 0))
    moves = np.diag(s) > 1e-12 * np.maximum(np.diag(xx)[1:] / n, 1e-300)
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    b, sb = np.zeros(len(c)), np.zeros(len(c))
    for _ in range(MOST_SWEEPS):
        largest = 0.0
        for j in np.flatnonzero(moves):
            rho = c[j] - sb[j] + s[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (s[j, j] + l2)
            if new != b[j]:
                sb += s[:, j] * (new - b[j])
                largest, b[j] = max(largest, abs(new - b[j]) * scale[j]), new
        if largest < TOLERANCE:
            break
    return np.concatenate([[mean_y - b @ mean], b])


@dataclass
class Path:
    """``grid``: every window and penalty; ``results``: the chosen one of each window; ``coefficients``: its values."""

    grid: DataFrame
    results: DataFrame
    coefficients: DataFrame


def elastic_net_path(panel: DataFrame, windows: DataFrame, names: Sequence[str], target: str, alphas: Sequence[float], l1_ratios: Sequence[float]) -> Path:
    """Walk-forward elastic net; the highest validation R2 of each window wins, ties to the earlier penalty.

    One aggregate of the panel by month gives all that is needed: sums over a
    block's months are the block's sums, each (window, penalty) is a problem of the
    predictors' number, and errors on any block follow from its sums.  Rows with a
    null are left out.  A window without rows in a block has null scores there; a
    window without any validation score chooses the first penalty.
    """
    k, all_names = len(names) + 1, ["intercept", *names]
    monthly = gram(panel, names, target, intercept=True)
    blocks = monthly.join(F.broadcast(windows.select("window_id", "block", "month")), "month").groupBy("window_id", "block").agg(*[F.sum(c).alias(c) for c in gram_names(k)])
    wide = blocks.groupBy("window_id").agg(*[F.max(F.when(F.col("block") == b, F.struct(*gram_names(k)))).alias(b) for b in ("train", "validation", "test")])
    combos = [(i, float(a), float(r)) for i, (a, r) in enumerate((a, r) for a in alphas for r in l1_ratios)]
    penalties = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(a).alias("alpha"), F.lit(r).alias("l1_ratio")) for i, a, r in combos])).alias("p")
    jobs = wide.where("train.n > 0").select("window_id", "train", "validation", "test", penalties).select("window_id", "p.*", "train", "validation", "test").repartition("window_id", "place")

    def sums(block: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.array([[block[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float), np.array([block[f"xy_{i}"] for i in range(k)], float)

    def score(block: dict | None, b: np.ndarray) -> float | None:
        if block is None or not block["yy"]:
            return None
        xx, xy = sums(block)
        return float(1 - (block["yy"] - 2 * b @ xy + b @ xx @ b) / block["yy"])

    def fit(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                b = coordinate_descent(*sums(r.train), r.train["n"], r.alpha, r.l1_ratio)
                out.append((r.window_id, r.place, r.alpha, r.l1_ratio, int(r.train["n"]), int((b[1:] != 0).sum()), *(score(x, b) for x in (r.train, r.validation, r.test)), b.tolist()))
            yield pd.DataFrame(out, columns=["window_id", "place", "alpha", "l1_ratio", "n_train", "n_used", "r2_train", "r2_validation", "r2_test", "b"])

    fits = jobs.mapInPandas(fit, "window_id int, place int, alpha double, l1_ratio double, n_train long, n_used int, r2_train double, r2_validation double, r2_test double, b array<double>")
    first = F.row_number().over(Window.partitionBy("window_id").orderBy(F.desc_nulls_last("r2_validation"), "place"))
    fits = fits.withColumn("selected", first == 1)
    grid = fits.select("window_id", "alpha", "l1_ratio", "n_used", "r2_train", "r2_validation", (F.col("r2_train") - F.col("r2_validation")).alias("gap"), "selected")
    chosen = fits.where("selected")
    results = chosen.select("window_id", "alpha", "l1_ratio", "n_train", "n_used", "r2_train", "r2_validation", "r2_test")
    values = chosen.select("window_id", F.explode(F.arrays_zip(F.array(*map(F.lit, all_names)).alias("predictor"), F.col("b").alias("coefficient"))).alias("x")).select("window_id", "x.predictor", "x.coefficient")
    return Path(grid, results, values)


def grid_by_two(grid: DataFrame, row: str, column: str, values: Sequence, score: str = "r2_validation") -> DataFrame:
    """Mean score over windows of each value of ``row``, a column for each of ``values`` of ``column``, with the row's rank by its best."""
    table = grid.groupBy(row).pivot(column, list(values)).agg(F.avg(score)).withColumnsRenamed({str(v): f"{column}_{v}" for v in values})
    best = F.array_max(F.array(*[F.col(f"`{column}_{v}`") for v in values]))
    return table.withColumn("rank", F.rank().over(Window.orderBy(F.desc_nulls_last(best))))  # a row a value
