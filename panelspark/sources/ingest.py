"""Sources, sinks and cleaning of raw tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions.keys import nan_to_null
from panelspark.operators.xsection import whole_quantiles
from panelspark.sources.scratch import discard


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table, pruned to ``columns``; NaN becomes null."""
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrites a Parquet table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def output_path(root: str, role: str, model: str, horizon: int = 1) -> str:
    """Place of a model's output; horizons never overwrite each other."""
    return f"{root}/{role}/model={model}/horizon={horizon}"


def factor_text(spark: SparkSession, path: str) -> DataFrame:
    """Monthly block of a factor text file: ``month`` and one double per named column.

    The header is the first line whose first field is empty; months are lines
    whose first field has exactly six digits, so annual blocks fall out.
    """
    lines = spark.read.text(path)
    head = lines.where(F.col("value").rlike(r"^\s*,.*\S")).limit(1).collect()
    if not head:
        raise ValueError(f"{path} has no header line")
    names = [n.strip().lower().replace("-", "").replace(" ", "") for n in head[0]["value"].split(",")[1:]]
    fields = F.split("value", ",")
    rows = lines.where(F.col("value").rlike(r"^\s*\d{6}\s*,"))
    return rows.select(F.trim(fields[0]).alias("month"), *[F.expr(f"try_cast(trim(split(value, ',')[{i + 1}]) as double)").alias(n) for i, n in enumerate(names)])


def clean_factors(five: DataFrame, momentum: DataFrame) -> DataFrame:
    """Both factor files on common months, in decimals, with six factors and the rate."""
    mom = momentum.select("month", F.col([c for c in momentum.columns if c != "month"][0]).alias("mom"))
    need = ["mktrf", "smb", "hml", "rmw", "cma", "rf"]
    if missing := [c for c in need if c not in five.columns]:
        raise ValueError(f"factors missing: {missing}")
    both = five.join(mom, "month")
    return both.select("month", *[(F.col(c) / 100).alias("rf_french" if c == "rf" else c) for c in need], (F.col("mom") / 100).alias("mom"))


def stack_models(tables: Mapping[str, DataFrame | None]) -> tuple[DataFrame, list[str]]:
    """Predictions of the models that exist, tagged and stacked; and the absent models."""
    there = {m: t for m, t in tables.items() if t is not None}
    if not there:
        raise ValueError("no model has predictions")
    out = None
    for model, table in there.items():
        tagged = table.withColumn("model", F.lit(model))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out, [m for m in tables if m not in there]


def append_new(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``fresh`` whose key ``existing`` has not, one a key (of several, the smallest in the columns' order); append these."""
    columns = [c for c in fresh.columns if c not in keys]
    fresh = fresh.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("__x")).select(*keys, "__x.*").select(*fresh.columns) if columns else fresh.distinct()
    return fresh.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def append_batch(spark: SparkSession, path: str, make: Callable[[], DataFrame], attempts: int = 20) -> None:
    """Adds the rows of ``make()``, which may read the table at ``path``, so that no other writer's come between.

    A table is a folder of numbered batches.  Rows are written aside first; their
    folder then takes the next number by a rename that fails where the number is
    taken.  In that case another writer came first, and the rows are made anew from
    what the table has by then.  Readers see whole batches only; a job that is lost
    leaves the table as it was.  The file system must rename folders atomically, as
    HDFS does.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    root = hadoop.Path(path)
    fs = root.getFileSystem(conf)
    fs.mkdirs(root)
    context = hadoop.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    for _ in range(attempts):
        names = [x.getPath().getName() for x in fs.listStatus(root)]  # one an append
        last = max((int(n.removeprefix("batch-")) for n in names if n.startswith("batch-")), default=0)
        aside = f"{path}/_aside-{uuid.uuid4().hex}"
        make().write.parquet(aside)
        try:
            context.rename(hadoop.Path(aside), hadoop.Path(f"{path}/batch-{last + 1:09d}"), options)
            return
        except Py4JJavaError as e:
            discard(spark, aside)
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
    raise RuntimeError(f"other writers of {path} came first {attempts} times")


def number(column: str | Column) -> Column:
    """Text to double; thousands commas go, what is no number becomes null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast("double")


def non_numeric_codes(df: DataFrame, column: str) -> DataFrame:
    """Count of each value that is present but no number."""
    bad = df.where(F.col(column).isNotNull() & F.col(column).try_cast("double").isNull())
    return bad.groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, null_rate``, all columns in one aggregate."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "feature", "null_rate")


def null_rates_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Mean over features of the null rate in each group."""
    rates = sum((F.avg(F.col(c).isNull().cast("double")) for c in columns), F.lit(0.0)) / len(columns)
    return df.groupBy(group).agg(rates.alias("mean_null_rate"))


def select_by_null_rate(df: DataFrame, candidates: Sequence[str], most: float = 0.35) -> DataFrame:
    """``feature, null_rate, kept``; candidates that the table lacks have no rate."""
    there = [c for c in candidates if c in df.columns]
    found = null_rates(df, there).withColumn("kept", F.col("null_rate") <= most)
    lacking = [c for c in candidates if c not in df.columns]
    if not lacking:
        return found
    more = df.sparkSession.createDataFrame([(c, None, False) for c in lacking], found.schema)
    return found.unionByName(more)


def source_profiles(sources: Mapping[str, DataFrame], entity: str = "entity", month: str = "month") -> DataFrame:
    """One row a source: rows, columns, entities (null where it has none), months, first and last month, and the mean
    null rate of its other columns (null without rows or other columns)."""
    out = None
    for name, df in sources.items():
        others = [c for c in df.columns if c not in (entity, month)]
        rate = sum((F.avg(F.col(c).isNull().cast("double")) for c in others), F.lit(0.0)) / len(others) if others else F.lit(None).cast("double")
        # distinct values apart: several in one aggregate multiply the rows
        distinct = [df.select(c).distinct().agg(F.count(c).alias(n)) if c in df.columns else df.sparkSession.range(1).select(F.lit(None).cast("long").alias(n)) for c, n in ((entity, "n_entities"), (month, "n_months"))]
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(month).alias("first_month"), F.max(month).alias("last_month"), rate.alias("null_rate"))
        one = one.crossJoin(distinct[0]).crossJoin(distinct[1]).select(F.lit(name).alias("source"), F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_rows", "n_entities", "n_months", "first_month", "last_month", "null_rate")
        out = one if out is None else out.unionByName(one)
    return out


def source_null_rates(sources: Mapping[str, DataFrame]) -> DataFrame:
    """``source, feature, null_rate`` of every column of every source."""
    out = None
    for name, df in sources.items():
        one = null_rates(df, df.columns).withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def source_overlap(sources: Mapping[str, DataFrame], key: str) -> DataFrame:
    """``left, right, n_left, n_right, n_both``: distinct keys of every two sources, from one grouping of all sources' keys; null is no key."""
    names, marked = list(sources), None
    for i, name in enumerate(names):
        one = sources[name].select(F.col(key).alias("key")).where("key is not null").distinct().withColumn("bit", F.lit(1 << i).cast("long"))
        marked = one if marked is None else marked.unionByName(one)
    masks = marked.groupBy("key").agg(F.bit_or("bit").alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    n = lambda bits: F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(bits).cast("long")) == bits, F.col("n"))), F.lit(0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    return masks.agg(F.array(*[F.struct(F.lit(names[i]).alias("left"), F.lit(names[j]).alias("right"), n(1 << i).alias("n_left"), n(1 << j).alias("n_right"), n(1 << i | 1 << j).alias("n_both")) for i, j in pairs]).alias("x")).select(F.inline("x"))


def sector_label(code: str = "sic2") -> Column:
    return F.coalesce(F.col(code).cast("int").cast("string"), F.lit("Inconnu"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return counts.limit(top) if top else counts


def extremes(df: DataFrame, column: str, high: float = 5.0, low: float = -0.95) -> DataFrame:
    """Counts beyond two bounds, and tail quantiles."""
    one = df.agg(F.count_if(F.col(column) > high).alias("n_high"), F.count_if(F.col(column) < low).alias("n_low"))
    one = one.crossJoin(F.broadcast(whole_quantiles(df, column, (0.001, 0.01, 0.5, 0.99, 0.999))))
    return one.select("n_high", "n_low", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q001", "q01", "q50", "q99", "q999"))])


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of each column, long."""
    long = df.select(*columns).unpivot([], list(columns), "feature", "x")
    agg = long.groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    agg = agg.join(F.broadcast(whole_quantiles(long, "x", (0.25, 0.5, 0.75), ["feature"])), "feature")
    return agg.select("feature", "n", "mean", "std", "min", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")


def fill_over_time(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Forward, then backward fill.  For tables with one row per period, which are small."""
    back = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)) for c in columns})


def log_inputs(df: DataFrame, columns: Sequence[str] = ("d12", "e12", "index")) -> DataFrame:
    """``feature, n_missing, n_not_positive``: the rows of each column for which :func:`macro_predictors` has no logarithm."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "x")
    return long.groupBy("feature").agg(F.count_if(F.col("x").isNull()).alias("n_missing"), F.count_if(F.col("x") <= 0).alias("n_not_positive"))


def macro_predictors(df: DataFrame) -> DataFrame:
    """Valuation and rate predictors; a logarithm of what is not positive is null."""
    log = lambda c: F.when(F.col(c) > 0, F.ln(c))
    return df.select(
        "month", (log("d12") - log("index")).alias("macro_dp"), (log("e12") - log("index")).alias("macro_ep"), F.col("bm").alias("macro_bm"), F.col("ntis").alias("macro_ntis"),
        F.col("tbl").alias("macro_tbl"), (F.col("lty") - F.col("tbl")).alias("macro_tms"), (F.col("baa") - F.col("aaa")).alias("macro_dfy"), F.col("svar").alias("macro_svar"),
    )


def write_manifest(selection: DataFrame, path: str) -> None:
    """Kept and excluded features with their null rates, as JSON: a row a feature."""
    selection.select("feature", "null_rate", "kept").write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, fallback: Sequence[str]) -> list[str]:
    """Kept features of a manifest in name order, or all of ``fallback`` where there is none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema("feature string, null_rate double, kept boolean").json(path).where("kept").orderBy("feature").collect()  # a row a feature
    except AnalysisException:
        return list(fallback)
    return [r["feature"] for r in rows]
