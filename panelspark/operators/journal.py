"""Append-only record of experiments, as tables."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelspark.sources.ingest import append_batch, append_new

#: Columns of the journal; horizon and target tell runs of a model apart.
SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("key", "model", "label", "target", "params_general", "params_specific")]
    + [T.StructField(c, T.DoubleType()) for c in ("duration_s", "r2_train", "r2_validation", "r2_test")]
    + [T.StructField(c, T.IntegerType()) for c in ("horizon", "n_windows")]
    + [T.StructField("logged_at", T.TimestampType())]
)


def snapshot(general: Mapping, shrink: int = 0, horizon: int = 1) -> dict:
    """Parameters that enter the key; shrinkage and horizon only when they are active."""
    return dict(general) | ({"shrink": shrink} if shrink else {}) | ({"horizon": horizon} if horizon > 1 else {})


def canonical_json(params: Mapping) -> str:
    return json.dumps(params, sort_keys=True, default=str)


def experiment_key(params_json: Column) -> Column:
    """First 16 hex digits of the SHA-256 of sorted JSON."""
    return F.substring(F.sha2(params_json, 256), 1, 16)


def ensemble_key(component_keys: Column, params_json: Column) -> Column:
    """Key of an ensemble, from its components' keys in order and its own parameters."""
    return experiment_key(F.concat(F.array_join(F.array_sort(component_keys), ","), F.lit("|"), params_json))


def label(params: Mapping) -> str:
    """Short text of a model's parameters; lists over four entries as min..max."""
    show = lambda v: f"{min(v)}..{max(v)}" if isinstance(v, (list, tuple)) and len(v) > 4 else ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    return " ".join(f"{k}={show(v)}" for k, v in params.items()) or "default"


def read_table(spark: SparkSession, path: str, schema: T.StructType = SCHEMA, defaults: Mapping | None = None) -> DataFrame:
    """A table by its schema: absent columns come as null, or a default; a missing table is empty."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    have = {c.lower() for c in df.columns}
    cols = []
    for f in schema:
        c = F.col(f.name) if f.name.lower() in have else F.lit(None)
        if defaults and f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str] = ("key",), schema: T.StructType = SCHEMA) -> None:
    """Appends the rows whose key the table has not; of writers at the same time, one row a key comes in."""
    append_batch(spark, path, lambda: append_new(read_table(spark, path, schema), rows, keys))


def latest(history: DataFrame, key: str | Sequence[str] = "key", at: str = "logged_at") -> DataFrame:
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.desc(at))
    return history.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def model_tables(journal: DataFrame, history: DataFrame) -> DataFrame:
    """Journal rows with the latest portfolio measures of their key, best test R2 first within (model, label)."""
    last = latest(history.select("key", "logged_at", "sharpe", "mean_annual")).drop("logged_at")
    rows = journal.join(last, "key", "left")
    w = Window.partitionBy("model", "label").orderBy(F.desc("r2_test"), "key")
    return rows.withColumn("place", F.row_number().over(w))


def ranking(journal: DataFrame) -> DataFrame:
    """All experiments by test R2, with the best of each model marked."""
    w = Window.partitionBy("model").orderBy(F.desc("r2_test"), "key")
    return journal.withColumn("best_of_model", F.row_number().over(w) == 1).orderBy(F.desc("r2_test"), "key")


def varied(journal: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``parameter, n_values`` of the columns that took several values."""
    one = journal.agg(*[F.countDistinct(c).alias(c) for c in columns])
    return one.unpivot([], list(columns), "parameter", "n_values").where("n_values > 1")


def run_counts(journal: DataFrame) -> DataFrame:
    return journal.groupBy("model", "label").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("duration_s").alias("mean_duration_s"), F.max("r2_test").alias("best_r2_test"))


def save_metrics(spark: SparkSession, path: str, step: str, values: Mapping) -> None:
    """Adds named values of a step to a report; call it after each part, so that earlier parts survive a failure."""
    rows = [(step, k, json.dumps(v, default=float)) for k, v in values.items()]
    table = spark.createDataFrame(rows, "step string, name string, value_json string")
    table.withColumn("saved_at", F.lit(time.time_ns())).write.mode("append").parquet(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``step, name, value_json``: the last value saved under each name; a missing report is empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("step", "name", "value_json")] + [T.StructField("saved_at", T.LongType())])
    return latest(read_table(spark, path, schema), ("step", "name"), "saved_at").drop("saved_at")
