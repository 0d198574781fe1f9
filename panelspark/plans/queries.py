"""Registered queries: one for each operator that has data to run on, with its DuckDB counterpart."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import keys
from panelspark.operators import costs as C
from panelspark.operators import ensemble as E
from panelspark.operators import horizon as H
from panelspark.operators import joins as J
from panelspark.operators import journal as G
from panelspark.operators import portfolios as P
from panelspark.operators import regressions as R
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.plans.registry import MEASURES, decile_sql, measures_sql, query
from panelspark.sources import ingest as I
from panelspark.sources import testpanel as T
from panelspark.sources.scratch import new_place, spread, written


def _panel(spark: SparkSession, d: str, entity: str = "l_partkey") -> DataFrame:
    return T.panel(spark, d, entity)


def _ex(spark: SparkSession, d: str, entity: str = "l_partkey") -> DataFrame:
    return _panel(spark, d, entity).withColumn("y", F.col("ret") - F.col("rf"))


def _dec(spark: SparkSession, d: str, entity: str = "l_partkey") -> DataFrame:
    return P.with_decile(_ex(spark, d, entity), "pred_a")


def _preds(spark: SparkSession, d: str) -> DataFrame:
    return T.predictions(_panel(spark, d))


# 2.1 sources and sinks


@query("src_pruned_scan", "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders", "o_totalprice", None)
def src_pruned_scan(s, d):
    return I.scan(s, f"{d}/orders.parquet", ["o_orderkey", "o_orderstatus", "o_totalprice"]).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("src_factor_load", "SELECT month, mktrf, smb, hml, rmw, cma, mom FROM factors", "mktrf smb hml rmw cma mom")
def src_factor_load(s, d):
    return T.factors(_panel(s, d)).drop("month_idx")


@query("src_stack_models", "SELECT model, count(*) AS n, sum(prediction) AS total FROM preds GROUP BY 1", "total")
def src_stack_models(s, d):
    p = _panel(s, d)
    stacked, _ = I.stack_models({"a": p.select("entity", "month", F.col("pred_a").alias("prediction")), "b": p.select("entity", "month", F.col("pred_b").alias("prediction")), "c": None})
    return stacked.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("total"))


@query("snk_append_new", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0", panel=None)
def snk_append_new(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    return I.append_new(orders.where("o_orderkey % 3 = 0"), orders, ["o_orderkey"])


@query("snk_overwrite", "SELECT entity, month, CAST(substring(month, 1, 4) AS INT) AS year, pred_a FROM panel WHERE month_idx % 2 = 0", "pred_a")
def snk_overwrite(s, d):
    """Two writes of a model's predictions to one place: the second one stands, and the other model's place is untouched."""
    rows = _panel(s, d).select("entity", "month", "month_idx", F.substring("month", 1, 4).cast("int").alias("year"), "pred_a")
    root = new_place(s, "outputs")
    place, other = (I.output_path(root, "predictions", m, 6) for m in ("a", "b"))
    I.write_table(rows.where("month_idx % 2 = 0"), other, ["year"])
    I.write_table(rows, place, ["year"])
    I.write_table(I.scan(s, other), place, ["year"])
    return I.scan(s, place, ["entity", "month", "year", "pred_a"])


@query("snk_append", "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS model, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS horizon, CAST(NULL AS INT) AS n_windows FROM orders", panel=None)
def snk_append(s, d):
    """A journal written twice: keys that are there stay as they are, others come in; absent columns read as null."""
    orders = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("model"), "o_orderkey")
    path = new_place(s, "journal")
    G.append(s, path, orders.where("o_orderkey % 3 = 0").select("key", "model", F.lit(1).alias("horizon")))
    G.append(s, path, orders.select("key", "model", F.lit(2).alias("horizon")))
    return G.read_table(s, path).select("key", "model", "horizon", "n_windows")


@query("snk_append_writers", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(1 AS BIGINT) AS n FROM orders", panel=None)
def snk_append_writers(s, d):
    """Two writers at the same time whose batches share keys, and one of them once more: a row a key."""
    orders = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("model"), "o_orderkey")
    path, batches = new_place(s, "journal"), [orders.where(f"o_orderkey % 3 <> {k}").select("key", "model") for k in (0, 1)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(inheritable_thread_target(s)(lambda rows: G.append(s, path, rows)), batches))
    G.append(s, path, batches[0])
    return G.read_table(s, path).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("snk_manifest", "SELECT feature, null_rate FROM (SELECT 'f1' AS feature, avg(CASE WHEN f1 IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM panel UNION ALL SELECT 'f2', avg(CASE WHEN f2 IS NULL THEN 1.0 ELSE 0 END) FROM panel UNION ALL SELECT 'f3', avg(CASE WHEN f3 IS NULL THEN 1.0 ELSE 0 END) FROM panel) WHERE null_rate <= 0.1", "null_rate")
def snk_manifest(s, d):
    p, path = _panel(s, d), new_place(s, "manifest")
    I.write_manifest(I.select_by_null_rate(p, ["f1", "f2", "f3", "f9"], 0.1), path)
    return I.null_rates(p, I.read_manifest(s, path, []))


@query("snk_report", "SELECT 'panel' AS step, 'n_rows' AS name, count(*)::DOUBLE AS value FROM panel UNION ALL SELECT 'panel', 'mean_ret', avg(ret) FROM panel UNION ALL SELECT 'windows', 'n_windows', count(DISTINCT window_id)::DOUBLE FROM win", "value")
def snk_report(s, d):
    """Figures of two steps, one of them reported twice; the report is read back with the last value of each."""
    path, p = new_place(s, "report"), _panel(s, d)
    G.save_metrics(s, path, "panel", {"n_rows": -1, "mean_ret": None})
    one = p.agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m")).first()
    G.save_metrics(s, path, "panel", {"n_rows": one["n"], "mean_ret": one["m"]})
    G.save_metrics(s, path, "windows", {"n_windows": _win(s, d).select("window_id").distinct().count()})
    return G.load_metrics(s, path).select("step", "name", F.col("value_json").cast("double").alias("value"))


@query("src_factor_text", "SELECT month, round(mktrf, 6) AS mktrf, CASE WHEN month_idx % 5 <> 0 THEN round(smb, 6) END AS smb FROM factors", "mktrf smb")
def src_factor_text(s, d):
    """The factors as a text file with notes, a header and yearly lines, read back."""
    f = T.factors(_panel(s, d))
    number = lambda c: F.format_string("%.6f", c)
    months = f.select(F.concat_ws(",", "month", number("mktrf"), F.when(F.col("month_idx") % 5 != 0, number("smb")).otherwise("x")).alias("value"))
    years = f.select(F.concat(F.substring("month", 1, 4), F.lit(", 1.0, 2.0")).alias("value")).distinct()
    head = s.createDataFrame([("a note",), (",Mkt-RF,SMB",)], "value string")
    path = new_place(s, "factor-text")
    head.unionByName(months).unionByName(years).write.text(path)
    return I.factor_text(s, path)


# 2.2 cleaning


@query("cln_year_decade", "SELECT date_int, date_int // 10000 AS year, date_int // 100000 * 10 AS decade, count(*) AS n FROM (SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS date_int FROM orders) GROUP BY 1, 2, 3", panel=None)
def cln_year_decade(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_int"))
    o = o.withColumn("year", keys.year_of("date_int"))
    return o.withColumn("decade", keys.decade_of("year")).groupBy("date_int", "year", "decade").agg(F.count(F.lit(1)).alias("n"))


@query("cln_start_filter", "SELECT entity, month FROM panel WHERE CAST(substring(month, 1, 4) AS INT) >= 1998")
def cln_start_filter(s, d):
    return W.restrict_start(_panel(s, d), 1998).select("entity", "month")


@query("cln_null_rates", "UNPIVOT (SELECT avg(CASE WHEN f1 IS NULL THEN 1.0 ELSE 0 END) AS f1, avg(CASE WHEN f2 IS NULL THEN 1.0 ELSE 0 END) AS f2, avg(CASE WHEN f3 IS NULL THEN 1.0 ELSE 0 END) AS f3 FROM panel) ON f1, f2, f3 INTO NAME feature VALUE null_rate", "null_rate")
def cln_null_rates(s, d):
    return I.null_rates(_panel(s, d), ["f1", "f2", "f3"])


@query("cln_null_rates_by_year", "SELECT year, avg(CASE WHEN f1 IS NULL THEN 1.0 ELSE 0 END) / 3 + avg(CASE WHEN f2 IS NULL THEN 1.0 ELSE 0 END) / 3 + avg(CASE WHEN f3 IS NULL THEN 1.0 ELSE 0 END) / 3 AS mean_null_rate FROM (SELECT *, CAST(substring(month, 1, 4) AS INT) AS year FROM panel) GROUP BY 1", "mean_null_rate")
def cln_null_rates_by_year(s, d):
    p = _panel(s, d).withColumn("year", F.substring("month", 1, 4).cast("int"))
    return I.null_rates_by(p, "year", ["f1", "f2", "f3"])


@query("cln_select_features", "SELECT feature, null_rate, null_rate <= 0.1 AS kept FROM (SELECT 'f1' AS feature, avg(CASE WHEN f1 IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM panel UNION ALL SELECT 'f2', avg(CASE WHEN f2 IS NULL THEN 1.0 ELSE 0 END) FROM panel) UNION ALL SELECT 'f9', NULL, false", "null_rate")
def cln_select_features(s, d):
    return I.select_by_null_rate(_panel(s, d), ["f1", "f2", "f9"], 0.1)


@query("cln_sector", "SELECT secteur, count(*) AS n FROM (SELECT coalesce(CAST(CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS VARCHAR), 'Inconnu') AS secteur FROM part) GROUP BY 1 ORDER BY n DESC, secteur LIMIT 10", panel=None)
def cln_sector(s, d):
    part = s.read.parquet(f"{d}/part.parquet").withColumn("sic2", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("double")))
    return I.value_counts(part.withColumn("secteur", I.sector_label()), "secteur", 10)


def _raw(s, d):
    p = _panel(s, d)
    text = F.when(F.col("entity") % 7 == 0, "C").when(F.col("entity") % 11 == 0, "B").when(F.col("entity") % 13 != 0, F.format_number("month_idx", 0))
    return p.select("entity", "month", text.alias("raw"))


_RAW = "SELECT entity, month, CASE WHEN entity % 7 = 0 THEN 'C' WHEN entity % 11 = 0 THEN 'B' WHEN entity % 13 <> 0 THEN format('{:,}', month_idx) END AS raw FROM panel"


@query("cln_codes", f"SELECT raw AS code, count(*) AS n FROM ({_RAW}) WHERE raw IN ('C', 'B') GROUP BY 1")
def cln_codes(s, d):
    return I.non_numeric_codes(_raw(s, d).withColumn("raw", F.replace(F.col("raw"), F.lit(","), F.lit(""))), "raw")


@query("cln_coercion", f"SELECT entity, month, TRY_CAST(replace(raw, ',', '') AS DOUBLE) AS x FROM ({_RAW}) WHERE TRY_CAST(replace(raw, ',', '') AS DOUBLE) IS NOT NULL", "x")
def cln_coercion(s, d):
    return _raw(s, d).select("entity", "month", I.number("raw").alias("x")).na.drop(subset=["x"])


@query("cln_extremes", "SELECT count(*) FILTER (ret > 0.06) AS n_high, count(*) FILTER (ret < -0.05) AS n_low, quantile_cont(ret, 0.001) AS q001, quantile_cont(ret, 0.01) AS q01, quantile_cont(ret, 0.5) AS q50, quantile_cont(ret, 0.99) AS q99, quantile_cont(ret, 0.999) AS q999 FROM panel", "q001 q01 q50 q99 q999")
def cln_extremes(s, d):
    return I.extremes(_panel(s, d), "ret", 0.06, -0.05)


@query("cln_profile", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM panel" for c in ("f1", "f2", "f3", "cap")), "mean std min q25 q50 q75 max")
def cln_profile(s, d):
    return I.profile(written(_panel(s, d).select("f1", "f2", "f3", "cap"), "profiled"), ["f1", "f2", "f3", "cap"])


@query("cln_duplicates", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, strftime(l_shipdate, '%Y%m'))", panel=None)
def cln_duplicates(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.date_format("l_shipdate", "yyyyMM").alias("month"))
    return keys.duplicate_keys(rows, ["l_suppkey", "month"])


@query("cln_keep_first", "SELECT l_partkey, month, l_orderkey, l_linenumber FROM (SELECT l_partkey, strftime(l_shipdate, '%Y%m') AS month, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, strftime(l_shipdate, '%Y%m') ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1", panel=None)
def cln_keep_first(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", F.date_format("l_shipdate", "yyyyMM").alias("month"), "l_orderkey", "l_linenumber")
    return keys.keep_first(rows, ["l_partkey", "month"], ["l_orderkey", "l_linenumber"])


_GAPPY = "SELECT month, month_idx, CASE WHEN month_idx % 4 <> 0 AND month_idx > (SELECT min(month_idx) FROM panel) + 1 THEN index_level END AS level FROM macro"


@query("cln_macro_fill", f"SELECT month, month_idx, coalesce(last_value(level IGNORE NULLS) OVER (ORDER BY month_idx ROWS UNBOUNDED PRECEDING), first_value(level IGNORE NULLS) OVER (ORDER BY month_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM ({_GAPPY})")
def cln_macro_fill(s, d):
    m = T.macro(_panel(s, d))
    first = m.agg(F.min("month_idx").alias("f"))
    m = m.crossJoin(F.broadcast(first)).select("month", "month_idx", F.when((F.col("month_idx") % 4 != 0) & (F.col("month_idx") > F.col("f") + 1), F.col("index_level")).alias("level"))
    return I.fill_over_time(m, "month_idx", ["level"])


@query("cln_macro_predictors", "SELECT month, ln(n_entities) - ln(index_level) AS macro_dp, CASE WHEN month_idx % 5 <> 0 THEN ln(month_idx) - ln(index_level) END AS macro_ep, rf * 2 AS macro_bm, rf AS macro_ntis, rf AS macro_tbl, rf * 2 AS macro_tms, rf AS macro_dfy, rf * rf AS macro_svar FROM macro", "macro_dp macro_ep macro_bm macro_ntis macro_tbl macro_tms macro_dfy macro_svar")
def cln_macro_predictors(s, d):
    return I.macro_predictors(_raw_macro(s, d))


@query("cln_log_inputs", "SELECT 'd12' AS feature, 0 AS n_missing, count(*) FILTER (n_entities <= 0) AS n_not_positive FROM macro UNION ALL SELECT 'e12', 0, count(*) FILTER (month_idx % 5 = 0) FROM macro UNION ALL SELECT 'index', count(*) FILTER (index_level IS NULL), count(*) FILTER (index_level <= 0) FROM macro")
def cln_log_inputs(s, d):
    return I.log_inputs(_raw_macro(s, d))


def _raw_macro(s, d):
    m = T.macro(_panel(s, d))
    return m.select("month", F.col("n_entities").cast("double").alias("d12"), F.when(F.col("month_idx") % 5 == 0, 0.0).otherwise(F.col("month_idx").cast("double")).alias("e12"), F.col("index_level").cast("double").alias("index"), (F.col("rf") * 2).alias("bm"), F.col("rf").alias("ntis"), F.col("rf").alias("tbl"), (F.col("rf") * 3).alias("lty"), (F.col("rf") * 2).alias("baa"), F.col("rf").alias("aaa"), (F.col("rf") * F.col("rf")).alias("svar"))


@query("cln_factors", "SELECT month, mktrf / 100 AS mktrf, smb / 100 AS smb, hml / 100 AS hml, rmw / 100 AS rmw, cma / 100 AS cma, rf / 100 AS rf_french, mom / 100 AS mom FROM factors JOIN (SELECT month, rf FROM macro) USING (month)", "mktrf smb hml rmw cma rf_french mom", digits=11)
def cln_factors(s, d):
    p = _panel(s, d)
    f = T.factors(p).drop("month_idx")
    return I.clean_factors(f.drop("mom").join(T.macro(p).select("month", "rf"), "month"), f.select("month", "mom"))


@query("cln_source_profile", "SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, min(month) AS first_month, max(month) AS last_month, avg(CASE WHEN f1 IS NULL THEN 1.0 ELSE 0 END) AS null_f1 FROM panel", "null_f1")
def cln_source_profile(s, d):
    return _panel(s, d).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity").alias("n_entities"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.avg(F.col("f1").isNull().cast("double")).alias("null_f1"))


def _sources(s, d):
    p = _panel(s, d)
    return {"prices": p.select("entity", "month", "ret", "cap"), "features": p.where("month_idx % 3 <> 0 and entity % 5 <> 0").select("entity", "month", "f1", "f2", "f3"), "macro": T.macro(p).select("month", "rf")}


@query("cln_source_profiles", """SELECT 'prices' AS source, CAST(4 AS BIGINT) AS n_columns, count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(DISTINCT month) AS n_months, min(month) AS first_month, max(month) AS last_month, (avg(CASE WHEN ret IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN cap IS NULL THEN 1.0 ELSE 0 END)) / 2 AS null_rate FROM panel
 UNION ALL SELECT 'features', 5, count(*), count(DISTINCT entity), count(DISTINCT month), min(month), max(month), (avg(CASE WHEN f1 IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN f2 IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN f3 IS NULL THEN 1.0 ELSE 0 END)) / 3 FROM panel WHERE month_idx % 3 <> 0 AND entity % 5 <> 0
 UNION ALL SELECT 'macro', 2, count(*), NULL, count(DISTINCT month), min(month), max(month), avg(CASE WHEN rf IS NULL THEN 1.0 ELSE 0 END) FROM macro""", "null_rate")
def cln_source_profiles(s, d):
    return I.source_profiles(_sources(s, d))


@query("cln_source_null_rates", "SELECT 'prices' AS source, 'entity' AS feature, avg(CASE WHEN entity IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM panel UNION ALL SELECT 'prices' AS source, 'month' AS feature, avg(CASE WHEN month IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM panel UNION ALL SELECT 'prices' AS source, 'ret' AS feature, avg(CASE WHEN ret IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM panel UNION ALL SELECT 'prices' AS source, 'cap' AS feature, avg(CASE WHEN cap IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM panel UNION ALL SELECT 'features' AS source, 'entity' AS feature, avg(CASE WHEN entity IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM panel WHERE month_idx % 3 <> 0 AND entity % 5 <> 0 UNION ALL SELECT 'features' AS source, 'month' AS feature, avg(CASE WHEN month IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM panel WHERE month_idx % 3 <> 0 AND entity % 5 <> 0 UNION ALL SELECT 'features' AS source, 'f1' AS feature, avg(CASE WHEN f1 IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM panel WHERE month_idx % 3 <> 0 AND entity % 5 <> 0 UNION ALL SELECT 'features' AS source, 'f2' AS feature, avg(CASE WHEN f2 IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM panel WHERE month_idx % 3 <> 0 AND entity % 5 <> 0 UNION ALL SELECT 'features' AS source, 'f3' AS feature, avg(CASE WHEN f3 IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM panel WHERE month_idx % 3 <> 0 AND entity % 5 <> 0 UNION ALL SELECT 'macro' AS source, 'month' AS feature, avg(CASE WHEN month IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM macro UNION ALL SELECT 'macro' AS source, 'rf' AS feature, avg(CASE WHEN rf IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM macro", "null_rate")
def cln_source_null_rates(s, d):
    return I.source_null_rates(_sources(s, d))


@query("cln_source_overlap", """SELECT 'prices' AS "left", 'features' AS "right", count(DISTINCT entity) AS n_left, count(DISTINCT entity) FILTER (month_idx % 3 <> 0 AND entity % 5 <> 0) AS n_right, count(DISTINCT entity) FILTER (month_idx % 3 <> 0 AND entity % 5 <> 0) AS n_both FROM panel""")
def cln_source_overlap(s, d):
    sources = _sources(s, d)
    return I.source_overlap({k: sources[k] for k in ("prices", "features")}, "entity")


# 2.3 joins


@query("jn_one_to_one", "SELECT a.entity, a.month, a.f3, b.ret FROM panel a JOIN panel b ON a.entity = b.entity AND a.month = b.month WHERE b.month_idx % 2 = 0", "f3 ret")
def jn_one_to_one(s, d):
    p = _panel(s, d)
    return J.one_to_one(p.select("entity", "month", "f3"), p.where("month_idx % 2 = 0").select("entity", "month", "ret"), ["entity", "month"])


@query("jn_lagged_macro", "SELECT p.entity, p.month, m.index_level FROM panel p LEFT JOIN macro m ON m.month_idx + 1 = p.month_idx")
def jn_lagged_macro(s, d):
    p = _panel(s, d)
    return J.lagged_macro(p.select("entity", "month"), T.macro(p), ["index_level"]).select("entity", "month", "index_level")


@query("jn_same_month", "SELECT entity, month, p.ret, m.rf FROM panel p JOIN macro m USING (month)", "ret rf")
def jn_same_month(s, d):
    p = _panel(s, d)
    return J.same_month(p.select("entity", "month", "ret"), T.macro(p), ["rf"])


@query("jn_drop_unmatched", "SELECT count(*) AS n_rows, count(*) FILTER (m.index_level IS NULL) AS n_unmatched FROM panel p LEFT JOIN macro m ON m.month_idx + 1 = p.month_idx")
def jn_drop_unmatched(s, d):
    p = _panel(s, d)
    return J.unmatched_count(J.lagged_macro(p.select("entity", "month"), T.macro(p), ["index_level"]), ["index_level"])


@query("jn_attach_target", "SELECT p.entity, p.month, f.target FROM panel p LEFT JOIN forward f ON p.entity = f.entity AND p.month_idx = f.month_idx", "target")
def jn_attach_target(s, d):
    p = _panel(s, d)
    return J.attach_target(p.select("entity", "month", "month_idx"), H.forward_excess(p, T.macro(p), 6).select("entity", "month_idx", "target"), ["entity", "month_idx"]).select("entity", "month", "target")


@query("jn_key_overlap", "SELECT count(*) FILTER (l) AS n_left, count(*) FILTER (r) AS n_right, count(*) FILTER (l AND r) AS n_both FROM (SELECT entity, bool_or(month < '199801') AS l, bool_or(month >= '200101') AS r FROM panel GROUP BY 1)")
def jn_key_overlap(s, d):
    p = _panel(s, d)
    return J.key_overlap(p.where("month < '199801'"), p.where("month >= '200101'"), "entity")


@query("jn_models_wide", "SELECT entity, month, pred_a AS a, pred_b AS b FROM panel", "a b")
def jn_models_wide(s, d):
    return J.models_wide(_preds(s, d), ["entity", "month"], ["a", "b"])


@query("jn_coverage", "SELECT count(*) AS n_rows, 100 * avg(CASE WHEN c.cap IS NULL THEN 1.0 ELSE 0 END) AS pct_missing FROM panel p LEFT JOIN (SELECT entity, month, cap FROM panel WHERE entity % 9 <> 0) c ON p.entity = c.entity AND p.month = c.month", "pct_missing")
def jn_coverage(s, d):
    p = _panel(s, d)
    return J.coverage(J.attach_target(p.select("entity", "month"), p.where("entity % 9 <> 0").select("entity", "month", "cap"), ["entity", "month"]), "cap")


@query("jn_loss_report", "SELECT count(*) AS n_rows, count(*) FILTER (entity % 9 = 0) AS n_lost, 100.0 * count(*) FILTER (entity % 9 = 0) / count(*) AS pct_lost FROM panel", "pct_lost")
def jn_loss_report(s, d):
    p = _panel(s, d)
    return J.attach_with_losses(p.select("entity", "month"), p.where("entity % 9 <> 0").select("entity", "month", "cap"), ["entity", "month"])[1]


@query("jn_cohort_self_join", "SELECT count(*) AS n, sum(p.ret) AS total FROM (SELECT entity, month_idx, decile, unnest(range(1, 7)) AS k FROM dec WHERE decile IS NOT NULL) f JOIN panel p ON p.entity = f.entity AND p.month_idx = f.month_idx + f.k", "total")
def jn_cohort_self_join(s, d):
    return P.cohort_positions(_ex(s, d), "pred_a", "ret", 6).agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"))


_SERIES = "SELECT 'ls' AS portfolio, month, ret FROM ls UNION ALL SELECT 'mkt', month, mktrf FROM factors WHERE month_idx % 5 <> 0"


def _series(s, d):
    ls = P.long_short(P.decile_returns(_dec(s, d), "y"))
    f = T.factors(_panel(s, d)).where("month_idx % 5 <> 0")
    return ls.select(F.lit("ls").alias("portfolio"), "month", "ret").unionByName(f.select(F.lit("mkt").alias("portfolio"), "month", F.col("mktrf").alias("ret")))


@query("jn_common_months", f"SELECT * FROM ({_SERIES}) WHERE month IN (SELECT month FROM ls INTERSECT SELECT month FROM factors WHERE month_idx % 5 <> 0)", "ret")
def jn_common_months(s, d):
    return J.common_months(_series(s, d))


# 2.4 cross-section


@query("xs_excess_return", "SELECT entity, month, y FROM ex", "y")
def xs_excess_return(s, d):
    return _ex(s, d).select("entity", "month", "y")


@query("xs_size_filter", "SELECT entity, month, cap FROM small", "cap")
def xs_size_filter(s, d):
    return X.filter_small(_panel(s, d)).select("entity", "month", "cap")


def _universe(s, d):
    return X.filter_illiquid(X.filter_small(_panel(s, d)))


@query("xs_liquidity_filter", "SELECT entity, month, illiq FROM universe", "illiq")
def xs_liquidity_filter(s, d):
    return _universe(s, d).select("entity", "month", "illiq")


def _filled(s, d):
    return X.impute_median(X.to_long(written(_universe(s, d), "universe"), ["entity", "month"], ["f1", "f2", "f3"]))


@query("xs_impute", "SELECT entity, month, feature, x FROM filled", "x")
def xs_impute(s, d):
    return _filled(s, d).select("entity", "month", "feature", "x")


@query("xs_winsorize", "SELECT entity, month, feature, x FROM clipped", "x")
def xs_winsorize(s, d):
    return X.winsorize(_filled(s, d)).select("entity", "month", "feature", "x")


@query("xs_rank_transform", "SELECT entity, month, feature, x FROM ranked", "x")
def xs_rank_transform(s, d):
    return X.rank_transform(X.winsorize(_filled(s, d))).select("entity", "month", "feature", "x")


@query("xs_normalise", "SELECT u.entity, u.month, u.cap AS cap_raw, max(CASE WHEN feature = 'f1' THEN x END) AS f1, max(CASE WHEN feature = 'f2' THEN x END) AS f2, max(CASE WHEN feature = 'f3' THEN x END) AS f3 FROM universe u JOIN ranked r ON u.entity = r.entity AND u.month = r.month GROUP BY 1, 2, 3", "cap_raw f1 f2 f3")
def xs_normalise(s, d):
    rows = written(_universe(s, d).withColumn("cap_raw", F.col("cap")), "universe")
    return X.normalise(rows, ["entity", "month"], ["f1", "f2", "f3"]).select("entity", "month", "cap_raw", "f1", "f2", "f3")


@query("xs_transform_check", "SELECT feature, stddev_samp(x) AS std, min(x) AS lowest, max(x) AS highest FROM ranked GROUP BY 1", "std lowest highest")
def xs_transform_check(s, d):
    return X.rank_transform(X.winsorize(_filled(s, d))).groupBy("feature").agg(F.stddev_samp("x").alias("std"), F.min("x").alias("lowest"), F.max("x").alias("highest"))


@query("xs_decile", "SELECT entity, month, decile FROM dec")
def xs_decile(s, d):
    return _dec(s, d).select("entity", "month", "decile")


@query("xs_top_fraction", "SELECT entity, month FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY pred_a DESC, entity) / count(*) OVER (PARTITION BY month) AS s FROM ex) WHERE s <= 0.1")
def xs_top_fraction(s, d):
    return X.top_fraction(_ex(s, d), "pred_a", "y", 0.1).select("entity", "month")


@query("xs_size_groups", "SELECT entity, month, size_group FROM grouped")
def xs_size_groups(s, d):
    return X.size_group(_panel(s, d), X.TERCILES).select("entity", "month", "size_group")


@query("xs_size_groups_fixed", "SELECT entity, month, CASE WHEN cap * 1000 <= 30000000 THEN 'small' WHEN cap * 1000 <= 60000000 THEN NULL ELSE 'large' END AS size_group FROM panel")
def xs_size_groups_fixed(s, d):
    groups = X.SizeGroups("fixed", (30_000_000, 60_000_000), ("small", None, "large"))
    return X.size_group(_panel(s, d).withColumn("dollars", F.col("cap") * 1000), groups, "dollars").select("entity", "month", "size_group")


# 2.5 long-horizon target


@query("hz_grid", "SELECT entity, month_idx, ext AS extension, status FROM grid")
def hz_grid(s, d):
    return H.monthly_grid(_panel(s, d), 6).select("entity", "month_idx", "extension", "status")


@query("hz_forward_excess", "SELECT entity, month_idx, target, n_observed, status FROM forward", "target")
def hz_forward_excess(s, d):
    p = _panel(s, d)
    return H.forward_excess(p, T.macro(p), 6)


@query("hz_forward_dense", "SELECT entity, month_idx, target, n_observed, status FROM forward", "target", "l_suppkey")
def hz_forward_dense(s, d):
    p = _panel(s, d, "l_suppkey")
    return H.forward_excess(p, T.macro(p), 6)


@query("hz_diagnosis", "SELECT count(target) AS n_valid, count(*) FILTER (target IS NULL AND month_idx + 6 <= panel_end) AS n_lost_gap, count(*) FILTER (target IS NULL AND month_idx + 6 > panel_end) AS n_lost_end, (SELECT count(*) FROM spans WHERE b - a + 1 > n) AS n_entities_gap, (SELECT count(*) FROM spans, ends WHERE b < panel_end) AS n_delisted, (SELECT count(*) FROM panel WHERE ret <= -1) AS n_total_losses FROM forward, ends")
def hz_diagnosis(s, d):
    p = _panel(s, d)
    return H.diagnose(p, T.macro(p), 6)


@query("hz_prepare", "SELECT entity, month_idx FROM forward WHERE target IS NOT NULL")
def hz_prepare(s, d):
    p = _panel(s, d)
    return H.prepare_panel(H.forward_excess(p, T.macro(p), 6), "target", 6).select("entity", "month_idx")


@query("hz_rate_check", "SELECT DISTINCT month_idx FROM panel WHERE month_idx % 10 = 0")
def hz_rate_check(s, d):
    p = _panel(s, d)
    return H.check_rates(p, T.macro(p).where("month_idx % 10 <> 0"))


# 2.6 windows and training

PLAN = W.WindowPlan("rolling", 3, 2, 1, shrink=1, shrink_from=2, floor=1)


def _win(s, d):
    return W.windows(_panel(s, d), PLAN)


@query("wf_windows", "SELECT * FROM win")
def wf_windows(s, d):
    return _win(s, d)


@query("wf_summary", "SELECT window_id, block, min(month) AS start, max(month) AS end, count(*) AS n_months, count(DISTINCT substring(month, 1, 4)) AS n_years FROM win GROUP BY 1, 2")
def wf_summary(s, d):
    return W.summarise(_win(s, d))


_EMB = "SELECT window_id, block, month, month_idx, test_year FROM (SELECT *, row_number() OVER (PARTITION BY window_id, block ORDER BY month_idx DESC) AS r FROM win) WHERE block = 'test' OR r > 6"


@query("wf_embargo", _EMB)
def wf_embargo(s, d):
    return W.embargo(_win(s, d), 6)


@query("wf_block_split", "SELECT window_id, block, count(*) AS n, sum(y) AS total FROM ex JOIN win USING (month) GROUP BY 1, 2", "total")
def wf_block_split(s, d):
    return W.assign(_ex(s, d), _win(s, d)).groupBy("window_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))


@query("wf_train_zscore", "SELECT window_id, block, avg(z) AS mean, stddev_samp(z) AS std FROM (SELECT window_id, block, (f3 - m) / s AS z FROM (SELECT * FROM ex JOIN win USING (month)) JOIN (SELECT window_id, avg(f3) AS m, stddev_samp(f3) AS s FROM ex JOIN win USING (month) WHERE block = 'train' GROUP BY 1) USING (window_id)) GROUP BY 1, 2", "mean std")
def wf_train_zscore(s, d):
    rows = W.assign(_ex(s, d), _win(s, d))
    z = X.train_zscore(rows, W.train_statistics(rows, ["f3"]), ["f3"])
    return z.groupBy("window_id", "block").agg(F.avg("f3").alias("mean"), F.stddev_samp("f3").alias("std"))


@query("wf_r2", "SELECT model, window_id, block, 1 - sum((y - prediction) ** 2) / sum(y ** 2) AS r2, count(*) AS n FROM preds JOIN win USING (month) GROUP BY 1, 2, 3", "r2")
def wf_r2(s, d):
    return W.r2_table(W.assign(_preds(s, d), _win(s, d)), ["model", "window_id", "block"])


@query("wf_pooled_r2", "SELECT model, block, 1 - sum((y - prediction) ** 2) / sum(y ** 2) AS r2, count(*) AS n FROM preds JOIN win USING (month) GROUP BY 1, 2", "r2")
def wf_pooled_r2(s, d):
    return W.r2_table(W.assign(_preds(s, d), _win(s, d)), ["model", "block"])


@query("wf_gram", "SELECT month, month_idx, n, yy, xy_0, xy_1, xx_0_0, xx_0_1, xx_1_1 FROM errs", "yy xy_0 xy_1 xx_0_0 xx_0_1 xx_1_1", digits=11)
def wf_gram(s, d):
    return E.gram(_ex(s, d), ["pred_a", "pred_b"], "y")


#: Slope, intercept and their standard errors of y on f3.
_FIT = "regr_slope(y, f3) AS b, regr_intercept(y, f3) AS a, sqrt(greatest(regr_syy(y, f3) - regr_slope(y, f3) * regr_sxy(y, f3), 0) / (count(*) - 2) / regr_sxx(y, f3)) AS sb, sqrt(greatest(regr_syy(y, f3) - regr_slope(y, f3) * regr_sxy(y, f3), 0) / (count(*) - 2) * (1.0 / count(*) + avg(f3) ** 2 / regr_sxx(y, f3))) AS sa"
_OLS1 = f"SELECT window_id, {_FIT} FROM ex JOIN win USING (month) WHERE block = 'train' GROUP BY 1"


@query("wf_window_ols", f"SELECT window_id, 'f3' AS predictor, b AS coefficient, sb AS std_error FROM ({_OLS1}) UNION ALL SELECT window_id, 'intercept', a, sa FROM ({_OLS1})", "coefficient std_error")
def wf_window_ols(s, d):
    return R.window_ols(_ex(s, d), _win(s, d), ["f3"], "y")


@query("wf_window_ols_r2", f"SELECT block, 1 - sum((y - a - b * f3) ** 2) / sum(y ** 2) AS r2, count(*) AS n FROM (SELECT * FROM ex JOIN win USING (month)) JOIN ({_OLS1}) USING (window_id) GROUP BY 1", "r2")
def wf_window_ols_r2(s, d):
    rows, table = _ex(s, d), _win(s, d)
    return W.r2_table(R.predict(W.assign(rows, table), R.window_ols(rows, table, ["f3"], "y"), ["f3"]), ["block"])


_SLOPES = "SELECT month, month_idx, regr_slope(y, f3) AS b, count(*) AS n FROM ex GROUP BY 1, 2 HAVING count(*) > 2 AND regr_slope(y, f3) IS NOT NULL"
_NW = """SELECT n, lags, mean, sqrt(greatest(s, 0)) / n AS nw_se, mean / (sqrt(greatest(s, 0)) / n) AS t_stat, share_positive FROM (
 SELECT st.*, (SELECT sum(CASE WHEN y.p = x.p THEN 1 ELSE 2 * (1 - (y.p - x.p) / (st.lags + 1.0)) END * (x.v - st.mean) * (y.v - st.mean)) FROM sl x, sl y WHERE y.p - x.p BETWEEN 0 AND st.lags) AS s FROM
 (SELECT count(*) AS n, CAST(greatest(1, floor(4 * power(count(*) / 100.0, 2 / 9.0))) AS INT) AS lags, avg(v) AS mean, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS share_positive FROM sl) st)"""


@query("wf_newey_west", _NW.replace("sl x, sl y", "(SELECT ret AS v, row_number() OVER (ORDER BY month) AS p FROM ls) x, (SELECT ret AS v, row_number() OVER (ORDER BY month) AS p FROM ls) y").replace("FROM sl)", "FROM (SELECT ret AS v FROM ls))"), "mean nw_se t_stat share_positive")
def wf_newey_west(s, d):
    ls = P.long_short(P.decile_returns(_dec(s, d), "y")).withColumn("predictor", F.lit("x"))
    return R.newey_west(ls, "ret", order="month").drop("predictor")


@query("wf_monthly_slopes", f"SELECT month, b AS coefficient FROM ({_SLOPES})", "coefficient")
def wf_monthly_slopes(s, d):
    return R.monthly_slopes(_ex(s, d), ["f3"], "y").where("predictor = 'f3'").select("month", "coefficient")


def _slopes_sql(names: list[str]) -> str:
    """Monthly slopes on several predictors: each one's part that the others leave, against the target."""
    parts = []
    for last in ["one", *names]:
        q = f"SELECT month, month_idx, y, 1.0::DOUBLE AS one, {', '.join(names)} FROM (SELECT *, count(*) OVER (PARTITION BY month) AS n_ FROM ex WHERE y IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in names)}) WHERE n_ > {len(names) + 1}"
        others = [c for c in ["one", *names] if c != last]
        for i, f in enumerate(others):
            rest = [*others[i + 1 :], last]
            q = f"SELECT month, month_idx, y, {', '.join(f'{x} - {f} * sum({x} * {f}) OVER v / sum({f} * {f}) OVER v AS {x}' for x in rest)} FROM ({q}) WINDOW v AS (PARTITION BY month)"
        parts.append(f"SELECT '{'intercept' if last == 'one' else last}' AS predictor, month, month_idx, sum({last} * y) / sum({last} * {last}) AS v FROM ({q}) GROUP BY month, month_idx")
    return " UNION ALL ".join(parts)


def _means_sql(names: list[str]) -> str:
    """Their means with Newey-West errors of the default lags."""
    st = "SELECT predictor, count(*) AS n, CAST(greatest(1, floor(4 * power(count(*) / 100.0, 2 / 9.0))) AS INT) AS lags, avg(v) AS mean, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS share_positive FROM sl GROUP BY 1"
    s = "SELECT x.predictor, sum(CASE WHEN z.p = x.p THEN 1 ELSE 2 * (1 - (z.p - x.p) / (lags + 1.0)) END * (x.v - mean) * (z.v - mean)) AS s FROM sl x JOIN sl z ON x.predictor = z.predictor JOIN st ON st.predictor = x.predictor WHERE z.p - x.p BETWEEN 0 AND lags GROUP BY 1"
    return f"WITH sl AS (SELECT *, row_number() OVER (PARTITION BY predictor ORDER BY month_idx) AS p FROM ({_slopes_sql(names)})), st AS ({st}) SELECT predictor, n, lags, mean, sqrt(greatest(s, 0)) / n AS nw_se, mean / (sqrt(greatest(s, 0)) / n) AS t_stat, share_positive FROM st JOIN ({s}) USING (predictor)"


@query("wf_fama_macbeth", f"SELECT *, abs(t_stat) > 1.959963984540054 AS significant FROM ({_means_sql(['f1', 'f2', 'f3'])})", "mean nw_se t_stat share_positive")
def wf_fama_macbeth(s, d):
    return R.fama_macbeth(_ex(s, d), ["f1", "f2", "f3"], "y").drop("p_value")


@query("wf_fama_macbeth_p_values")
def wf_fama_macbeth_p_values(s, d):
    return R.fama_macbeth(_ex(s, d), ["f1", "f2", "f3"], "y").select("predictor", "t_stat", "p_value")


@query("wf_window_significance")
def wf_window_significance(s, d):
    return R.window_significance(R.monthly_slopes(_ex(s, d), ["f1", "f2", "f3"], "y"), _win(s, d))


@query("wf_coefficient_stability")
def wf_coefficient_stability(s, d):
    return R.coefficient_stability(R.window_ols(_ex(s, d), _win(s, d), ["f1", "f2", "f3"], "y"))


_FITS = f"SELECT month, month_idx, {_FIT} FROM ex GROUP BY 1, 2 HAVING count(*) > 2 AND regr_slope(y, f3) IS NOT NULL"
_BOTH_SLOPES = f"SELECT 'f3' AS predictor, month, month_idx, b AS v, sb AS se FROM ({_FITS}) UNION ALL SELECT 'intercept', month, month_idx, a, sa FROM ({_FITS})"


def _fama_macbeth_sql(predictor: str) -> str:
    rows = f"(SELECT v, row_number() OVER (ORDER BY month_idx) AS p FROM ({_BOTH_SLOPES}) WHERE predictor = '{predictor}')"
    return f"SELECT '{predictor}' AS predictor, *, abs(t_stat) > 1.959963984540054 AS significant FROM ({_NW.replace('sl x, sl y', f'{rows} x, {rows} y').replace('FROM sl)', f'FROM {rows})')})"


@query("wf_fama_macbeth_one", f"{_fama_macbeth_sql('f3')} UNION ALL {_fama_macbeth_sql('intercept')}", "mean nw_se t_stat share_positive")
def wf_fama_macbeth_one(s, d):
    """One predictor, so that SQL can say the same; the p-value's normal law is in the flag."""
    return R.fama_macbeth(_ex(s, d), ["f3"], "y").drop("p_value")


@query("wf_window_significance_one", f"SELECT window_id, predictor, count(*) AS n_months, avg(CASE WHEN abs(v / nullif(se, 0)) >= 1.96 THEN 1.0 ELSE 0 END) AS share_significant, avg(v) / avg(abs(v)) AS coherence FROM ({_BOTH_SLOPES}) JOIN win USING (month) WHERE block = 'train' GROUP BY 1, 2 HAVING count(*) >= 6", "share_significant coherence")
def wf_window_significance_one(s, d):
    return R.window_significance(R.monthly_slopes(_ex(s, d), ["f3"], "y"), _win(s, d))


@query("wf_coefficient_stability_one", f"SELECT 'f3' AS predictor, avg(abs(b)) AS mean_abs, 100 * avg(CASE WHEN b <> 0 THEN 1.0 ELSE 0 END) AS pct_selected, avg(b) FILTER (b <> 0) AS mean_if_selected, CASE WHEN count(*) FILTER (b > 0) >= 0.5 * count(*) FILTER (b <> 0) THEN 1 ELSE -1 END AS dominant_sign, 100.0 * greatest(count(*) FILTER (b > 0), count(*) FILTER (b < 0)) / count(*) FILTER (b <> 0) AS pct_agreement, count(*) FILTER (b > 0) = 0 OR count(*) FILTER (b < 0) = 0 AS sign_stable FROM ({_OLS1})", "mean_abs pct_selected mean_if_selected pct_agreement")
def wf_coefficient_stability_one(s, d):
    return R.coefficient_stability(R.window_ols(_ex(s, d), _win(s, d), ["f3"], "y"))


# 2.7 portfolios


@query("pf_decile_returns", "SELECT month, decile, ret FROM decret", "ret", digits=11)
def pf_decile_returns(s, d):
    return P.decile_returns(_dec(s, d), "y")


@query("pf_decile_returns_weighted", "SELECT month, decile, ret FROM decretw", "ret", digits=11)
def pf_decile_returns_weighted(s, d):
    return P.decile_returns(_dec(s, d), "y", weight="cap")


def _ls(s, d):
    return P.long_short(P.decile_returns(_dec(s, d), "y"))


@query("pf_long_short", "SELECT month, ret FROM ls", "ret", digits=11)
def pf_long_short(s, d):
    return _ls(s, d)


@query("pf_decile_profile", "SELECT decile, avg(ret) AS mean_ret, count(*) AS n_months FROM decret GROUP BY 1", "mean_ret")
def pf_decile_profile(s, d):
    return P.decile_profile(P.decile_returns(_dec(s, d), "y"))


@query("pf_decile_sizes", "SELECT decile, avg(n) AS mean_entities FROM (SELECT month, decile, count(*) AS n FROM dec WHERE decile IS NOT NULL GROUP BY 1, 2) GROUP BY 1", "mean_entities")
def pf_decile_sizes(s, d):
    return P.decile_sizes(_dec(s, d))


_LO = "SELECT month, avg(y) AS e, sum(cap * y) / sum(cap) AS c FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY pred_a DESC, entity) / count(*) OVER (PARTITION BY month) AS s FROM ex) WHERE s <= 0.1 GROUP BY 1"


@query("pf_long_only", f"SELECT month, e AS ret FROM ({_LO})", "ret")
def pf_long_only(s, d):
    return P.long_only(_ex(s, d), "pred_a", "y", 0.1)


@query("pf_cohorts", "SELECT month, decile, avg(p_ret) AS ret, max(n_cohorts) AS n_cohorts FROM (SELECT p.month, f.decile, p.ret AS p_ret, f.month_idx AS formation FROM (SELECT entity, month_idx, decile, unnest(range(1, 7)) AS k FROM dec WHERE decile IS NOT NULL) f JOIN panel p ON p.entity = f.entity AND p.month_idx = f.month_idx + f.k) JOIN (SELECT month, count(DISTINCT formation) AS n_cohorts FROM (SELECT p.month, f.month_idx AS formation FROM (SELECT entity, month_idx, unnest(range(1, 7)) AS k FROM dec WHERE decile IS NOT NULL) f JOIN panel p ON p.entity = f.entity AND p.month_idx = f.month_idx + f.k) GROUP BY 1) USING (month) GROUP BY 1, 2", "ret", digits=11)
def pf_cohorts(s, d):
    return P.cohorts(_ex(s, d), "pred_a", "ret", 6)


@query("pf_annual", "SELECT * FROM (SELECT month, avg(CASE WHEN decile = 10 THEN target END) - avg(CASE WHEN decile = 1 THEN target END) AS ret FROM dec JOIN forward USING (entity, month_idx) WHERE (month_idx - (SELECT min(month_idx) FROM panel)) % 6 = 0 GROUP BY 1) WHERE ret IS NOT NULL", "ret")
def pf_annual(s, d):
    p = written(_ex(s, d), "panel")
    p, macro = spread(p, "entity"), written(T.macro(p), "macro")
    rows = J.attach_target(p, H.forward_excess(p, macro, 6).select("entity", "month_idx", "target"), ["entity", "month_idx"])
    return P.annual_rebalance(written(rows.select("entity", "month", "month_idx", "pred_a", "target"), "targets"), "pred_a", "target", 6)


@query("pf_monthly_rebalance", "SELECT * FROM (SELECT month, max(CASE WHEN decile = 10 THEN r END) - max(CASE WHEN decile = 1 THEN r END) AS ret FROM (SELECT month, decile, avg(ret) AS r FROM dec GROUP BY 1, 2) GROUP BY 1) WHERE ret IS NOT NULL", "ret")
def pf_monthly_rebalance(s, d):
    return P.monthly_rebalance(_ex(s, d), "pred_a", "ret")


@query("pf_constructions", f"SELECT 'long_short_equal' AS construction, month, ret FROM ls UNION ALL SELECT * FROM (SELECT 'long_short_weighted', month, max(CASE WHEN decile = 10 THEN ret END) - max(CASE WHEN decile = 1 THEN ret END) AS ret FROM decretw GROUP BY month) WHERE ret IS NOT NULL UNION ALL SELECT 'long_only_equal', month, e FROM ({_LO}) UNION ALL SELECT 'long_only_weighted', month, c FROM ({_LO})", "ret")
def pf_constructions(s, d):
    return P.compare_constructions(_ex(s, d), "pred_a", "y", "cap")


_CON = f"SELECT 'long_short_equal' AS portfolio, month, ret FROM ls UNION ALL SELECT * FROM (SELECT 'long_short_weighted', month, max(CASE WHEN decile = 10 THEN ret END) - max(CASE WHEN decile = 1 THEN ret END) AS ret FROM decretw GROUP BY month) WHERE ret IS NOT NULL UNION ALL SELECT 'long_only_equal', month, e FROM ({_LO}) UNION ALL SELECT 'long_only_weighted', month, c FROM ({_LO})"


@query("pf_construction_gaps", f"SELECT portfolio AS construction, * EXCLUDE (portfolio), sharpe - max(CASE WHEN portfolio = 'long_short_equal' THEN sharpe END) OVER () AS sharpe_gap FROM ({measures_sql('(' + _CON + ')')})", f"{MEASURES} sharpe_gap")
def pf_construction_gaps(s, d):
    return P.construction_gaps(P.compare_constructions(_ex(s, d), "pred_a", "y", "cap"))


@query("pf_largest", "SELECT entity, month, cap FROM panel ORDER BY cap DESC, entity, month LIMIT 10", "cap")
def pf_largest(s, d):
    return P.largest(_panel(s, d))


@query("pf_benchmarks", "SELECT size_group, month, avg(y) AS equal_weighted, sum(cap * y) / sum(cap) AS size_weighted FROM grouped GROUP BY 1, 2", "equal_weighted size_weighted", digits=11)
def pf_benchmarks(s, d):
    return P.universe_benchmarks(X.size_group(_ex(s, d), X.TERCILES), "y", "cap", by=["size_group"])


@query("pf_wealth", f"SELECT portfolio, month, exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio ORDER BY month)) AS wealth FROM ({_SERIES})", "wealth")
def pf_wealth(s, d):
    return P.wealth(_series(s, d)).drop("ret")


@query("pf_measures", measures_sql(f"({_SERIES})"), MEASURES)
def pf_measures(s, d):
    return P.measures(_series(s, d))


#: Student's two-sided p-value with whole degrees of freedom nu, as a finite series.
_STUDENT = """greatest(0, 1 - CASE WHEN nu % 2 = 0
  THEN s * list_sum(list_transform(range(0, nu // 2), lambda j: exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - 2 * j * ln(2)) * c2 ** j))
  ELSE 2 / pi() * (asin(s) + CASE WHEN nu > 1 THEN s * list_sum(list_transform(range(0, (nu - 1) // 2), lambda j: exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * c2 ** (j + 0.5))) ELSE 0 END) END)"""


@query("pf_p_values", f"SELECT portfolio, t_stat, {_STUDENT} AS p_value FROM (SELECT portfolio, t_stat, n_months - 1 AS nu, (n_months - 1) / (n_months - 1 + t_stat ** 2) AS c2, abs(t_stat) / sqrt(n_months - 1 + t_stat ** 2) AS s FROM ({measures_sql(f'({_SERIES})')}))", "t_stat p_value")
def pf_p_values(s, d):
    return P.measures(_series(s, d), p_value=True).select("portfolio", "t_stat", "p_value")


_IC = "SELECT model, month, CASE WHEN count(*) >= 10 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic, count(*) AS n FROM (SELECT model, month, rank() OVER (PARTITION BY model, month ORDER BY prediction) + (count(*) OVER (PARTITION BY model, month, prediction) - 1) / 2.0 AS a, rank() OVER (PARTITION BY model, month ORDER BY y) + (count(*) OVER (PARTITION BY model, month, y) - 1) / 2.0 AS b FROM preds) GROUP BY 1, 2"


@query("pf_rank_ic", _IC, "ic")
def pf_rank_ic(s, d):
    return P.rank_ic(_preds(s, d), "prediction", "y", by=["model", "month"])


@query("pf_rank_ic_summary", f"SELECT model, count(ic) AS n_months, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_sd, avg(ic) / stddev_samp(ic) * sqrt(12) AS ic_ir, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS ic_t, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS share_positive FROM ({_IC}) WHERE ic IS NOT NULL GROUP BY 1", "ic_mean ic_sd ic_ir ic_t share_positive")
def pf_rank_ic_summary(s, d):
    return P.rank_ic_summary(P.rank_ic(_preds(s, d), "prediction", "y", by=["model", "month"]), ["model"])


_BOTH = "SELECT p.*, g.size_group FROM preds p JOIN grouped g ON p.entity = g.entity AND p.month = g.month UNION ALL SELECT *, 'all' FROM preds"
_GROUP_IC = _IC.replace("model, month", "model, size_group, month").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3").replace("FROM preds", f"FROM ({_BOTH})")


@query("pf_evaluate_groups", f"SELECT model, size_group, n_rows, n_entities, n_months_available, r2, n_months, {', '.join(MEASURES.split())}, ic_mean, ic_t, n_months_available - coalesce(n_months, 0) AS n_months_without FROM (SELECT model || '|' || size_group AS portfolio, model, size_group, count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(DISTINCT month) AS n_months_available, 1 - sum((y - prediction) ** 2) / sum(y ** 2) AS r2 FROM ({_BOTH}) GROUP BY 1, 2, 3) LEFT JOIN ({measures_sql('(SELECT * FROM (SELECT model || chr(124) || size_group AS portfolio, month, avg(CASE WHEN decile = 10 THEN y END) - avg(CASE WHEN decile = 1 THEN y END) AS ret FROM (' + decile_sql('(' + _BOTH + ')', 'prediction', 'model, size_group, month') + ') GROUP BY 1, 2) WHERE ret IS NOT NULL)')}) USING (portfolio) LEFT JOIN (SELECT model, size_group, CASE WHEN count(ic) >= 2 THEN avg(ic) END AS ic_mean, CASE WHEN count(ic) >= 2 AND stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END AS ic_t FROM ({_GROUP_IC}) WHERE ic IS NOT NULL GROUP BY 1, 2) USING (model, size_group)", f"r2 {MEASURES} ic_mean ic_t")
def pf_evaluate_groups(s, d):
    rows = X.size_group(_preds(s, d), X.TERCILES)
    return P.evaluate_groups(rows, "prediction", "y")


@query("pf_describe_groups", "SELECT size_group, n_rows, n_entities, n_months, mean_per_month, min_per_month, max_per_month, size_min, size_p25, size_median, size_mean, size_p75, size_max, total / (SELECT sum(cap) FROM panel) AS share_of_total FROM (SELECT size_group, count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(DISTINCT month) AS n_months, min(cap) AS size_min, quantile_cont(cap, 0.25) AS size_p25, quantile_cont(cap, 0.5) AS size_median, avg(cap) AS size_mean, quantile_cont(cap, 0.75) AS size_p75, max(cap) AS size_max, sum(cap) AS total FROM grouped GROUP BY 1) JOIN (SELECT size_group, avg(n) AS mean_per_month, min(n) AS min_per_month, max(n) AS max_per_month FROM (SELECT size_group, month, count(*) AS n FROM grouped GROUP BY 1, 2) GROUP BY 1) USING (size_group)", "mean_per_month size_min size_p25 size_median size_mean size_p75 size_max share_of_total")
def pf_describe_groups(s, d):
    # read for the cuts and for the groups; it has one row per entity and month, so no copies to drop
    rows = written(_panel(s, d).select("entity", "month", "cap"), "panel")
    return P.describe_groups(X.size_group(rows, X.TERCILES, universe=None))


@query("pf_group_bounds", "SELECT month, size_group, min(cap) AS size_min, quantile_cont(cap, 0.5) AS size_median, max(cap) AS size_max, count(*) AS n FROM grouped GROUP BY 1, 2", "size_min size_median size_max")
def pf_group_bounds(s, d):
    return P.group_bounds(X.size_group(_panel(s, d), X.TERCILES))


@query("pf_partition_check", "SELECT count(*) FILTER (cap * 1000 <= 30000000 OR cap * 1000 > 60000000) AS n_grouped, count(*) FILTER (cap * 1000 > 30000000 AND cap * 1000 <= 60000000) AS n_excluded, count(*) AS n_universe FROM panel")
def pf_partition_check(s, d):
    groups = X.SizeGroups("fixed", (30_000_000, 60_000_000), ("small", None, "large"))
    return P.partition_check(X.size_group(_preds(s, d).withColumn("dollars", F.col("cap") * 1000), groups, "dollars"))


@query("pf_best_group", f"SELECT model, max_by(size_group, (ic, -o)) AS best_ic FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY size_group) AS o FROM (SELECT model, size_group, avg(ic) AS ic FROM ({_IC.replace('model, month', 'model, size_group, month').replace('GROUP BY 1, 2', 'GROUP BY 1, 2, 3').replace('FROM preds', 'FROM (SELECT p.*, size_group FROM preds p JOIN (SELECT entity, month, size_group FROM grouped) g ON p.entity = g.entity AND p.month = g.month)')}) GROUP BY 1, 2)) GROUP BY 1")
def pf_best_group(s, d):
    ic = P.rank_ic(X.size_group(_preds(s, d), X.TERCILES), "prediction", "y", by=["model", "size_group", "month"])
    return P.best_by(ic.groupBy("model", "size_group").agg(F.avg("ic").alias("ic")), "model", "size_group", ["ic"])


_GROUPED = "(SELECT p.*, size_group FROM preds p JOIN (SELECT entity, month, size_group FROM grouped) g ON p.entity = g.entity AND p.month = g.month)"
_GROUP_LS = f"SELECT * FROM (SELECT model || '_' || size_group AS portfolio, month, avg(CASE WHEN decile = 10 THEN y END) - avg(CASE WHEN decile = 1 THEN y END) AS ret FROM ({decile_sql(_GROUPED, 'prediction', 'model, size_group, month')}) GROUP BY 1, 2) WHERE ret IS NOT NULL"


@query("pf_best_group_sharpe", f"SELECT substring(portfolio, 1, 1) AS model, arg_max(substring(portfolio, 3), sharpe ORDER BY portfolio) AS best_sharpe FROM ({measures_sql('(' + _GROUP_LS + ')')}) WHERE sharpe IS NOT NULL GROUP BY 1")
def pf_best_group_sharpe(s, d):
    table = P.evaluate_groups(X.size_group(_preds(s, d), X.TERCILES), "prediction", "y").where("size_group <> 'all' and sharpe is not null")
    return P.best_by(table, "model", "size_group", ["sharpe"])


_HZ = "SELECT 1 AS horizon, entity, month, pred_a, y AS target, y FROM ex UNION ALL SELECT 6, p.entity, p.month, p.pred_a, round(f.target, 9), p.y FROM ex p JOIN forward f ON p.entity = f.entity AND p.month_idx = f.month_idx WHERE f.target IS NOT NULL"
_HZ_IC = f"SELECT horizon, avg(ic) AS ic_mean, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS ic_t, count(ic) AS n_months_ic FROM (SELECT horizon, month, CASE WHEN count(*) >= 10 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM (SELECT horizon, month, rank() OVER (PARTITION BY horizon, month ORDER BY pred_a) + (count(*) OVER (PARTITION BY horizon, month, pred_a) - 1) / 2.0 AS a, rank() OVER (PARTITION BY horizon, month ORDER BY target) + (count(*) OVER (PARTITION BY horizon, month, target) - 1) / 2.0 AS b FROM ({_HZ})) GROUP BY 1, 2) GROUP BY 1"
_HZ_LS = f"SELECT * FROM (SELECT CAST(horizon AS VARCHAR) AS portfolio, month, avg(CASE WHEN decile = 10 THEN y END) - avg(CASE WHEN decile = 1 THEN y END) AS ret FROM ({decile_sql('(' + _HZ + ')', 'pred_a', 'horizon, month')}) GROUP BY 1, 2) WHERE ret IS NOT NULL"


@query("pf_horizon_comparison", f"SELECT horizon, ic_mean, ic_t, n_months_ic, n_months, {', '.join(MEASURES.split())}, sharpe - first(sharpe) OVER (ORDER BY horizon) AS sharpe_gap FROM ({_HZ_IC}) i LEFT JOIN ({measures_sql('(' + _HZ_LS + ')')}) m ON m.portfolio = CAST(i.horizon AS VARCHAR)", f"ic_mean ic_t {MEASURES} sharpe_gap", "l_suppkey")
def pf_horizon_comparison(s, d):
    p = spread(written(_ex(s, d, "l_suppkey"), "panel"), "entity")
    far = H.forward_excess(p, T.macro(p), 6).where("target is not null").select("entity", "month_idx", F.round("target", 9).alias("target"))
    return P.compare_horizons({1: p.withColumn("target", F.col("y")), 6: p.join(far, ["entity", "month_idx"])}, "pred_a", "target", "y")


@query("pf_scale_ratio", "SELECT stddev_samp(y) AS sd_short, stddev_samp(target) AS sd_long, (stddev_samp(target) / stddev_samp(y)) ** 2 AS variance_ratio FROM ex JOIN forward USING (entity, month_idx)", "sd_short sd_long variance_ratio", "l_suppkey")
def pf_scale_ratio(s, d):
    p = _ex(s, d, "l_suppkey")
    return P.scale_ratio(p.join(H.forward_excess(p, T.macro(p), 6).select("entity", "month_idx", "target"), ["entity", "month_idx"]), "y", "target")


def _model_table(s, d):
    long = _preds(s, d)
    spread = P.long_short(P.decile_returns(P.with_decile(long, "prediction", by=["model", "month"]), "y", by=["model", "month"]), by=["model", "month"])
    return W.r2_table(long, ["model"]).select("model", "r2").join(P.measures(spread, ["model"]).select("model", "sharpe"), "model")


_TABLE = f"SELECT model, r2, sharpe FROM (SELECT model, 1 - sum((y - prediction) ** 2) / sum(y ** 2) AS r2 FROM preds GROUP BY 1) JOIN (SELECT portfolio AS model, sharpe FROM ({measures_sql('(SELECT model AS portfolio, month, ret FROM mls)')})) USING (model)"


@query("pf_accuracy_vs_value", f"SELECT *, rank() OVER (ORDER BY r2 DESC) AS rank_accuracy, rank() OVER (ORDER BY sharpe DESC) AS rank_value, rank() OVER (ORDER BY r2 DESC) <> rank() OVER (ORDER BY sharpe DESC) AS disagree FROM ({_TABLE})", "r2 sharpe")
def pf_accuracy_vs_value(s, d):
    return P.rank_disagreement(_model_table(s, d))


@query("pf_model_comparison", "SELECT model, max(CASE WHEN block = 'train' THEN r2 END) AS train, max(CASE WHEN block = 'test' THEN r2 END) AS test, max(CASE WHEN block = 'train' THEN r2 END) - max(CASE WHEN block = 'test' THEN r2 END) AS gap FROM (SELECT model, block, 1 - sum((y - prediction) ** 2) / sum(y ** 2) AS r2 FROM preds JOIN win USING (month) GROUP BY 1, 2) GROUP BY 1", "train test gap")
def pf_model_comparison(s, d):
    r2 = W.r2_table(W.assign(_preds(s, d), _win(s, d)), ["model", "block"])
    return r2.groupBy("model").pivot("block", ["train", "test"]).agg(F.first("r2")).withColumn("gap", F.col("train") - F.col("test"))


@query("pf_model_blocks", "SELECT *, train - validation AS gap_validation, validation - test AS gap_test FROM (SELECT model, max(CASE WHEN block = 'train' THEN r2 END) AS train, max(CASE WHEN block = 'validation' THEN r2 END) AS validation, max(CASE WHEN block = 'test' THEN r2 END) AS test FROM (SELECT model, block, 1 - sum((y - prediction) ** 2) / sum(y ** 2) AS r2 FROM preds JOIN win USING (month) GROUP BY 1, 2) GROUP BY 1)", "train validation test gap_validation gap_test")
def pf_model_blocks(s, d):
    return W.block_table(W.assign(_preds(s, d), _win(s, d)), ["model"])


# 2.8 combination


@query("en_components", f"SELECT r.model AS method, r2, n, n_months, {', '.join(MEASURES.split())}, 0 AS n_fallback FROM (SELECT model, 1 - sum((y - prediction) ** 2) / sum(y ** 2) AS r2, count(*) AS n FROM preds GROUP BY 1) r LEFT JOIN ({measures_sql('(SELECT model AS portfolio, month, ret FROM mls)')}) m ON m.portfolio = r.model", f"r2 {MEASURES}")
def en_components(s, d):
    return E.components(_preds(s, d))


@query("en_constant_weights", "SELECT 'equal' AS method, model, 0.5 AS w FROM (VALUES ('a'), ('b')) t(model) UNION ALL SELECT 'validation_r2', model, CASE WHEN sum(r) OVER () > 0 THEN r / sum(r) OVER () ELSE 0.5 END FROM (SELECT model, greatest(1 - sum((y - prediction) ** 2) / sum(y ** 2), 0) AS r FROM preds GROUP BY 1)", "w")
def en_constant_weights(s, d):
    scores = W.r2_table(_preds(s, d), ["model"]).select("model", F.col("r2").alias("validation_r2"))
    equal, by_r2 = (E.constant_weights(scores, m).select(F.lit(m).alias("method"), "model", "w") for m in ("equal", "validation_r2"))
    return equal.unionByName(by_r2)


def _monthly(s, d):
    return E.gram(_ex(s, d), ["pred_a", "pred_b"], "y")


@query("en_inverse_mse", "SELECT month, month_idx, fallback, 'a' AS model, wa AS w FROM iw UNION ALL SELECT month, month_idx, fallback, 'b', wb FROM iw", "w")
def en_inverse_mse(s, d):
    return E.inverse_mse_weights(_monthly(s, d), ["a", "b"])


@query("en_least_squares", "SELECT month, fallback, unnest(['a', 'b']) AS model, unnest([w, 1 - w]) AS w FROM (SELECT month, n_past < 24 AS fallback, CASE WHEN n_past < 24 THEN 0.5 ELSE least(greatest(((sa - sb) - (ab - bb)) / (aa - 2 * ab + bb), 0), 1) END AS w FROM (SELECT month, count(*) OVER v AS n_past, sum(xy_0) OVER v AS sa, sum(xy_1) OVER v AS sb, sum(xx_0_0) OVER v AS aa, sum(xx_0_1) OVER v AS ab, sum(xx_1_1) OVER v AS bb FROM errs WINDOW v AS (ORDER BY month_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)))", "w")
def en_least_squares(s, d):
    return E.least_squares_weights(_monthly(s, d), ["a", "b"]).select("month", "fallback", "model", "w")


@query("en_combine", "SELECT entity, month, wa * pred_a + wb * pred_b AS prediction FROM panel JOIN iw USING (month)", "prediction")
def en_combine(s, d):
    return E.combine(_preds(s, d), E.inverse_mse_weights(_monthly(s, d), ["a", "b"]))


_LSW = "SELECT month, n_past < 24 AS fallback, CASE WHEN n_past < 24 THEN 0.5 ELSE least(greatest(((sa - sb) - (ab - bb)) / (aa - 2 * ab + bb), 0), 1) END AS w FROM (SELECT month, count(*) OVER v AS n_past, sum(xy_0) OVER v AS sa, sum(xy_1) OVER v AS sb, sum(xx_0_0) OVER v AS aa, sum(xx_0_1) OVER v AS ab, sum(xx_1_1) OVER v AS bb FROM errs WINDOW v AS (ORDER BY month_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"
_MW = f"SELECT 'equal' AS method, month, CAST(0.5 AS DOUBLE) AS wa, CAST(0.5 AS DOUBLE) AS wb, false AS fallback FROM errs UNION ALL SELECT 'manual', month, 0.3, 0.7, false FROM errs UNION ALL SELECT 'validation_r2', month, CASE WHEN ra + rb > 0 THEN ra / (ra + rb) ELSE 0.5 END, CASE WHEN ra + rb > 0 THEN rb / (ra + rb) ELSE 0.5 END, ra + rb <= 0 FROM errs, (SELECT greatest(1 - sum((y - pred_a) ** 2) / sum(y ** 2), 0) AS ra, greatest(1 - sum((y - pred_b) ** 2) / sum(y ** 2), 0) AS rb FROM ex) UNION ALL SELECT 'inverse_mse', month, wa, wb, fallback FROM iw UNION ALL SELECT 'least_squares', month, w, 1 - w, fallback FROM ({_LSW})"
_MP = f"SELECT method, e.entity, e.month, y, wa * pred_a + wb * pred_b AS prediction FROM ex e JOIN ({_MW}) m ON e.month = m.month"
_MLS = f"SELECT * FROM (SELECT method AS portfolio, month, avg(CASE WHEN decile = 10 THEN y END) - avg(CASE WHEN decile = 1 THEN y END) AS ret FROM ({decile_sql('(' + _MP + ')', 'prediction', 'method, month')}) GROUP BY 1, 2) WHERE ret IS NOT NULL"


def _all_weights(s, d):
    monthly = written(_monthly(s, d), "monthly")
    scores = written(W.r2_table(_preds(s, d), ["model"]).select("model", F.col("r2").alias("validation_r2")), "scores")
    every = [E.weight_table(monthly, scores, ["a", "b"], m, manual={"a": 0.3, "b": 0.7}) for m in E.METHODS]
    return reduce(DataFrame.unionByName, every)


@query("en_weight_table", f"SELECT method, month, fallback, 'a' AS model, wa AS w FROM ({_MW}) UNION ALL SELECT method, month, fallback, 'b', wb FROM ({_MW})", "w")
def en_weight_table(s, d):
    return _all_weights(s, d).drop("month_idx")


@query("en_fallback_counts", f"SELECT method, count(*) AS n_months, count(*) FILTER (fallback) AS n_fallback FROM ({_MW}) GROUP BY 1")
def en_fallback_counts(s, d):
    return E.fallback_counts(_all_weights(s, d))


@query("en_mean_weights", f"SELECT method, 'a' AS model, avg(wa) AS mean_w FROM ({_MW}) GROUP BY 1 UNION ALL SELECT method, 'b', avg(wb) FROM ({_MW}) GROUP BY 1", "mean_w")
def en_mean_weights(s, d):
    return E.mean_weights(_all_weights(s, d))


@query("en_compare_methods", f"SELECT r.*, m.* EXCLUDE (portfolio), n_fallback FROM (SELECT method, 1 - sum((y - prediction) ** 2) / sum(y ** 2) AS r2, count(*) AS n FROM ({_MP}) GROUP BY 1) r LEFT JOIN ({measures_sql('(' + _MLS + ')')}) m ON m.portfolio = r.method JOIN (SELECT method, count(*) FILTER (fallback) AS n_fallback FROM ({_MW}) GROUP BY 1) f ON f.method = r.method", f"r2 {MEASURES}")
def en_compare_methods(s, d):
    return E.replay(_preds(s, d), _all_weights(s, d))


@query("en_error_correlation_summary", "SELECT c AS mean_corr, c AS min_corr, c AS max_corr FROM (SELECT corr(y - pred_a, y - pred_b) AS c FROM ex)", "mean_corr min_corr max_corr")
def en_error_correlation_summary(s, d):
    return E.correlation_summary(E.error_correlation(_ex(s, d).select("y", F.col("pred_a").alias("a"), F.col("pred_b").alias("b")), ["a", "b"]))


@query("en_error_correlation", "SELECT 'a' AS model_1, 'a' AS model_2, 1.0 AS corr UNION ALL SELECT 'a', 'b', corr(y - pred_a, y - pred_b) FROM ex UNION ALL SELECT 'b', 'b', 1.0", "corr")
def en_error_correlation(s, d):
    return E.error_correlation(_ex(s, d).select("y", F.col("pred_a").alias("a"), F.col("pred_b").alias("b")), ["a", "b"])


# 2.9 turnover and costs; suppliers, whose months follow each other


def _legs(s, d):
    df = _dec(s, d, "l_suppkey")
    return df, C.leg_weights(df, F.col("decile") == 10, "long").unionByName(C.leg_weights(df, F.col("decile") == 1, "short")), C.entity_returns(df)


@query("tc_leg_weights", "SELECT leg, month, entity, w FROM w", "w", "l_suppkey")
def tc_leg_weights(s, d):
    return _legs(s, d)[1].drop("month_idx")


@query("tc_leg_weights_cap", "SELECT month, entity, cap / sum(cap) OVER (PARTITION BY month) AS w FROM dec WHERE decile = 10", "w", "l_suppkey")
def tc_leg_weights_cap(s, d):
    return C.leg_weights(_dec(s, d, "l_suppkey"), F.col("decile") == 10, "long", "cap").select("month", "entity", "w")


@query("tc_drift", "SELECT leg, month, entity, w * (1 + r) / sum(w * (1 + r)) OVER (PARTITION BY leg, month) AS drifted FROM w", "drifted", "l_suppkey")
def tc_drift(s, d):
    _, w, r = _legs(s, d)
    return C.drifted(w, r).select("leg", "month", "entity", "drifted")


@query("tc_turnover", "SELECT leg, month, month_idx, turnover, entries_exits, rebalancing FROM turn", "turnover entries_exits rebalancing", "l_suppkey")
def tc_turnover(s, d):
    _, w, r = _legs(s, d)
    return C.turnover(w, r)


_HELD = """
WITH RECURSIVE panel AS ({panel}), ex AS (SELECT *, ret - rf AS y FROM panel), dec AS ({dec}),
 m AS (SELECT month_idx, row_number() OVER (ORDER BY month_idx) AS p FROM (SELECT DISTINCT month_idx FROM dec)),
 d AS (SELECT entity, p, month, coalesce(decile >= 10, false) AS i, coalesce(decile >= 9, false) AS o FROM dec JOIN m USING (month_idx)),
 h AS (SELECT entity, p, month, i AS held FROM d WHERE p = 1
       UNION ALL SELECT d.entity, d.p, d.month, d.i OR (d.o AND coalesce(h.held, false)) FROM (SELECT DISTINCT p AS hp FROM h) x JOIN d ON d.p = x.hp + 1 LEFT JOIN h ON h.entity = d.entity)
SELECT entity, month, held FROM h"""


def _buffer_sql() -> str:
    from panelspark.plans.registry import decile_sql as ds
    from panelspark.sources.testpanel import panel_sql

    return _HELD.format(panel=panel_sql("l_suppkey"), dec=ds("ex", "pred_a"))


@query("tc_buffer", _buffer_sql(), panel=None)
def tc_buffer(s, d):
    return C.buffered(_dec(s, d, "l_suppkey"), 10, 9).select("entity", "month", "held")


@query("tc_leg_returns", "SELECT leg, month, sum(w * r) AS ret FROM w GROUP BY 1, 2", "ret", "l_suppkey")
def tc_leg_returns(s, d):
    _, w, r = _legs(s, d)
    return C.leg_returns(w, r).drop("month_idx")


@query("tc_monthly_costs", "SELECT * FROM cost", "turnover trade_cost borrow_cost cost", "l_suppkey")
def tc_monthly_costs(s, d):
    _, w, r = _legs(s, d)
    return C.monthly_costs(C.turnover(w, r), 10, 100)


def _net(s, d):
    return C.long_short_with_costs(_dec(s, d, "l_suppkey"), 10, 100)


@query("tc_net_returns", "SELECT month, ret, net FROM net", "ret net", "l_suppkey")
def tc_net_returns(s, d):
    return _net(s, d).select("month", "ret", "net")


_STACKED = "(SELECT entity, month, month_idx, ret, cap, 'a' AS model, pred_a AS prediction FROM ex UNION ALL SELECT entity, month, month_idx, ret, cap, 'b', pred_b FROM ex)"
_WEIGHTED = f"SELECT d.*, model || '_' || weighting AS portfolio, CASE WHEN weighting = 'size' THEN cap ELSE 1.0 END AS weight FROM ({decile_sql(_STACKED, 'prediction', 'model, month')}) d, (VALUES ('equal'), ('size')) t(weighting)"
_BY_LEGS = f"""
SELECT portfolio, leg, month, month_idx, entity, weight / sum(weight) OVER (PARTITION BY portfolio, leg, month) AS w, ret AS r
FROM (SELECT CASE WHEN decile = 10 THEN 'long' ELSE 'short' END AS leg, * FROM ({_WEIGHTED}) WHERE decile IN (1, 10) AND weight > 0)"""
_BY_TURNS = f"""
WITH w AS ({_BY_LEGS}), pos AS (SELECT *, row_number() OVER (PARTITION BY portfolio, leg ORDER BY month_idx) AS p FROM (SELECT DISTINCT portfolio, leg, month, month_idx FROM w)),
 now AS (SELECT w.portfolio, w.leg, p, entity, w FROM w JOIN pos USING (portfolio, leg, month_idx)),
 bef AS (SELECT w.portfolio, w.leg, p + 1 AS p, entity, w * (1 + r) / sum(w * (1 + r)) OVER (PARTITION BY w.portfolio, w.leg, w.month_idx) AS d FROM w JOIN pos USING (portfolio, leg, month_idx)),
 turn AS (SELECT portfolio, leg, p, sum(abs(coalesce(w, 0) - coalesce(d, 0))) AS turnover FROM now FULL JOIN bef USING (portfolio, leg, p, entity) GROUP BY 1, 2, 3),
 costs AS (SELECT portfolio, month, month_idx, sum(turnover) AS turnover FROM turn JOIN pos USING (portfolio, leg, p) GROUP BY 1, 2, 3),
 gross AS (SELECT portfolio, month, sum(CASE WHEN leg = 'long' THEN w * r END) - sum(CASE WHEN leg = 'short' THEN w * r END) AS ret FROM w GROUP BY 1, 2),
 late AS (SELECT * FROM costs c WHERE month_idx > (SELECT min(month_idx) FROM costs o WHERE o.portfolio = c.portfolio))
SELECT portfolio, month, ret, turnover, ret - coalesce(turnover * 0.001 + 0.01 / 12, 0) AS net FROM gross LEFT JOIN late USING (portfolio, month) WHERE ret IS NOT NULL"""


def _portfolios(s, d):
    """Two models by two weightings, equal and by size, as four portfolios of one job."""
    stacked = _panel(s, d).select("entity", "month", "month_idx", "ret", "cap", F.expr("stack(2, 'a', pred_a, 'b', pred_b) as (model, prediction)"))
    ranked = P.with_decile(stacked, "prediction", by=["model", "month"])
    return C.weightings(ranked, {"equal": None, "size": "cap"}).withColumn("portfolio", F.concat_ws("_", "model", "weighting"))


@query("tc_portfolios", _BY_TURNS, "ret turnover net")
def tc_portfolios(s, d):
    """Gross and net returns and turnover of all portfolios in one job."""
    return C.long_short_with_costs(_portfolios(s, d), 10, 100, weight="weight", by=["portfolio"], returns=C.entity_returns(_panel(s, d))).select("portfolio", "month", "ret", "turnover", "net")


@query("tc_portfolio_measures", measures_sql(f"(SELECT portfolio, month, net AS ret FROM ({_BY_TURNS}))"), MEASURES)
def tc_portfolio_measures(s, d):
    net = C.long_short_with_costs(_portfolios(s, d), 10, 100, weight="weight", by=["portfolio"], returns=C.entity_returns(_panel(s, d)))
    return P.measures(net.select("portfolio", "month", F.col("net").alias("ret")))


@query("tc_break_even_zero", "SELECT n, (g - 0.01 / 12) / q * 10000 AS zero_mean_bps FROM (SELECT count(*) AS n, avg(ret) AS g, avg(turnover) AS q FROM net WHERE turnover IS NOT NULL)", "zero_mean_bps", "l_suppkey")
def tc_break_even_zero(s, d):
    return C.break_even(_net(s, d), 100).select("n", "zero_mean_bps")


BREAK_EVEN_SQL = """
SELECT n, m / q * 10000 AS zero_mean_bps,
  CASE WHEN n < 3 THEN NULL WHEN coalesce(m / nullif(sqrt(v / n), 0), 0) < 1.96 THEN 0.0 WHEN (m - 0.05 * q) / sqrt((v - 0.1 * k + 0.0025 * s) / n) > 1.96 THEN CAST('Infinity' AS DOUBLE)
    ELSE 10000 * CASE WHEN least(r1, r2) >= 0 THEN least(r1, r2) ELSE greatest(r1, r2) END END AS significance_bps
FROM (SELECT *, (-b - sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) AS r1, (-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) AS r2
  FROM (SELECT *, q * q - 1.96 * 1.96 * s / n AS a, 2 * 1.96 * 1.96 * k / n - 2 * m * q AS b, m * m - 1.96 * 1.96 * v / n AS c
    FROM (SELECT count(*) AS n, avg(ret) + 0.01 - 0.01 / 12 AS m, avg(turnover) AS q, var_samp(ret) AS v, var_samp(turnover) AS s, covar_samp(ret, turnover) AS k FROM net WHERE turnover IS NOT NULL)))"""


@query("tc_break_even_significance", BREAK_EVEN_SQL, "zero_mean_bps significance_bps", "l_suppkey")
def tc_break_even_significance(s, d):
    rows = _net(s, d).withColumn("ret", F.col("ret") + 0.01)
    return C.break_even(rows, 100)


@query("tc_sensitivity", "SELECT CAST(portfolio AS DOUBLE) AS cost_bps, mean_annual, volatility_annual, sharpe, t_stat FROM (" + measures_sql("(SELECT CAST(g AS VARCHAR) AS portfolio, month, ret - turnover * g / 10000 - 0.01 / 12 AS ret FROM net, (VALUES (0.0), (10.0), (25.0)) t(g) WHERE turnover IS NOT NULL)") + ")", "cost_bps mean_annual volatility_annual sharpe t_stat", "l_suppkey")
def tc_sensitivity(s, d):
    return C.sensitivity(_net(s, d).where("turnover is not null"), [0, 10, 25], 100)


@query("tc_turnover_summary", "SELECT leg, avg(turnover) AS mean_turnover, avg(turnover) * 12 AS annual_turnover, 4 / avg(turnover) AS holding_months, count(*) AS n_months FROM turn GROUP BY 1", "mean_turnover annual_turnover holding_months", "l_suppkey")
def tc_turnover_summary(s, d):
    _, w, r = _legs(s, d)
    return C.turnover_summary(C.turnover(w, r), ["leg"])


@query("tc_gross_vs_net", "SELECT portfolio, mean_annual, sharpe FROM (" + measures_sql("(SELECT 'gross' AS portfolio, month, ret FROM net UNION ALL SELECT 'net', month, net FROM net)") + ")", "mean_annual sharpe", "l_suppkey")
def tc_gross_vs_net(s, d):
    rows = _net(s, d)
    both = rows.select(F.lit("gross").alias("portfolio"), "month", "ret").unionByName(rows.select(F.lit("net").alias("portfolio"), "month", F.col("net").alias("ret")))
    return P.measures(both).select("portfolio", "mean_annual", "sharpe")


@query("tc_margin", f"SELECT *, zero_mean_bps - 10 AS margin_bps, significance_bps - 10 AS significance_margin_bps FROM ({BREAK_EVEN_SQL.replace(' + 0.01 - ', ' - ')})", "zero_mean_bps significance_bps margin_bps significance_margin_bps", "l_suppkey")
def tc_margin(s, d):
    return C.margins(C.break_even(_net(s, d), 100), 10)


@query("tc_drags", "SELECT *, (trade_drag_annual + borrow_drag_annual) / gross_annual AS drag_ratio FROM (SELECT 12 * avg(ret) AS gross_annual, 12 * avg(net) AS net_annual, 12 * avg(coalesce(turnover * 0.001, 0)) AS trade_drag_annual, 12 * avg(CASE WHEN cost IS NULL THEN 0 ELSE 0.01 / 12 END) AS borrow_drag_annual FROM net)", "gross_annual net_annual trade_drag_annual borrow_drag_annual drag_ratio", "l_suppkey")
def tc_drags(s, d):
    return C.drags(_net(s, d))


@query("tc_consistency", "SELECT CAST(0.0 AS DOUBLE) AS largest_gap, count(*) AS n_months FROM grossw", "largest_gap", "l_suppkey")
def tc_consistency(s, d):
    df = _dec(s, d, "l_suppkey")
    a = P.long_short(P.decile_returns(df, "ret")).withColumnRenamed("ret", "by_decile")
    return _net(s, d).join(a, "month").agg(F.max(F.abs(F.col("ret") - F.col("by_decile"))).alias("largest_gap"), F.count(F.lit(1)).alias("n_months"))


# 2.10 factors


@query("fa_one_factor", "SELECT portfolio, regr_intercept(ret, mktrf) AS alpha, regr_slope(ret, mktrf) AS beta, regr_r2(ret, mktrf) AS r2, count(*) AS n_months FROM (SELECT 'ls' AS portfolio, month, ret FROM ls) JOIN factors USING (month) GROUP BY 1", "alpha beta r2")
def fa_one_factor(s, d):
    return R.one_factor(_ls(s, d).withColumn("portfolio", F.lit("ls")), T.factors(_panel(s, d)))


def _alpha_sql(series: str, lags: int = 3) -> str:
    """Alphas of ``series`` (portfolio, month, ret) under all factor models, by residuals of one factor after the other.

    What is left of the constant, h, gives alpha = sum(h y) / sum(h h), and h e / sum(h h) its Newey-West error.
    """
    parts = []
    for model, names in R.MODELS.items():
        q = f"SELECT portfolio, month, ret, ret AS y, 1.0::DOUBLE AS c, {', '.join(names)} FROM ({series}) JOIN factors USING (month) WHERE ret IS NOT NULL"
        for i, f in enumerate(names):
            rest = ["y", "c", *names[i + 1 :]]
            q = f"SELECT portfolio, month, ret, {', '.join(f'{x} - {f} * sum({x} * {f}) OVER v / sum({f} * {f}) OVER v AS {x}' for x in rest)} FROM ({q}) WINDOW v AS (PARTITION BY portfolio)"
        parts.append(f"SELECT portfolio, '{model}' AS factor_model, {len(names)} AS k, month, ret, c / sum(c * c) OVER v AS h, sum(c * y) OVER v / sum(c * c) OVER v AS alpha, y - c * sum(c * y) OVER v / sum(c * c) OVER v AS e FROM ({q}) WINDOW v AS (PARTITION BY portfolio)")
    u = f"SELECT *, h * e AS u, row_number() OVER (PARTITION BY portfolio, factor_model ORDER BY month) AS p FROM ({' UNION ALL '.join(parts)})"
    hac = f"SELECT x.portfolio, x.factor_model, sum(CASE WHEN z.p = x.p THEN 1 ELSE 2 * (1 - (z.p - x.p) / {lags + 1}.0) END * x.u * z.u) AS v FROM u x JOIN u z ON x.portfolio = z.portfolio AND x.factor_model = z.factor_model AND z.p - x.p BETWEEN 0 AND {lags} GROUP BY 1, 2"
    one = "SELECT portfolio, factor_model, k, count(*) AS n, max(alpha) AS a, sum(e * e) AS ee, sum(ret * ret) - count(*) * avg(ret) ** 2 AS yy FROM u GROUP BY 1, 2, 3"
    return f"""WITH u AS ({u}) SELECT portfolio, factor_model, n AS n_months, a AS alpha, 12 * a AS alpha_annual, a / sqrt(v * n / (n - k - 1)) AS t_alpha, 1 - ee / yy AS r2,
      sqrt(ee / (n - k - 1)) * sqrt(12) AS residual_vol, 12 * a / (sqrt(ee / (n - k - 1)) * sqrt(12)) AS information_ratio FROM ({one}) JOIN ({hac}) USING (portfolio, factor_model)"""


_ALPHAS = _alpha_sql("SELECT 'ls' AS portfolio, month, ret FROM ls")


def _alphas(s, d):
    return R.factor_alphas(_ls(s, d).withColumn("portfolio", F.lit("ls")), T.factors(_panel(s, d)), lags=R.default_lags(1))


@query("fa_alphas", _ALPHAS, "alpha alpha_annual t_alpha r2 residual_vol information_ratio")
def fa_alphas(s, d):
    return _alphas(s, d).drop("betas", "t_betas", "p_alpha")


@query("fa_alpha_p_values")
def fa_alpha_p_values(s, d):
    return _alphas(s, d).select("portfolio", "factor_model", "t_alpha", "p_alpha", "betas", "t_betas")


@query("fa_absorbed_alpha", f"SELECT portfolio, s AS alpha_small, l AS alpha_large, s - l AS absorbed FROM (SELECT portfolio, max(alpha_annual) FILTER (factor_model = 'FF5') AS s, max(alpha_annual) FILTER (factor_model = 'FF5+MOM') AS l FROM ({_ALPHAS}) GROUP BY 1)", "alpha_small alpha_large absorbed")
def fa_absorbed_alpha(s, d):
    return R.absorbed_alpha(_alphas(s, d))


@query("fa_report", f"SELECT portfolio, 100 * alpha_annual AS alpha_annual_pct, 100 * r2 AS r2_pct, 100 * residual_vol AS residual_vol_pct, t_alpha, information_ratio, n_months FROM ({_ALPHAS}) WHERE factor_model = 'FF5'", "alpha_annual_pct r2_pct residual_vol_pct t_alpha information_ratio")
def fa_report(s, d):
    return R.report_alphas(_alphas(s, d), "FF5")


#: Alpha of a series (portfolio, month, ret) under one factor, with Newey-West errors of three lags and the small-sample factor.
_CAPM = """
 SELECT portfolio, n AS n_months, a AS alpha, 12 * a AS alpha_annual, a / sqrt(va * n / (n - 2)) AS t_alpha, r2, sqrt(ee / (n - 2)) * sqrt(12) AS residual_vol,
   12 * a / (sqrt(ee / (n - 2)) * sqrt(12)) AS information_ratio, b AS beta, b / sqrt(vb * n / (n - 2)) AS t_beta
 FROM (SELECT *, (SELECT sum(CASE WHEN v.p = u.p THEN 1 ELSE 2 * (1 - (v.p - u.p) / 4.0) END * u.ga * v.ga) FROM gs u, gs v WHERE u.portfolio = v.portfolio AND v.p - u.p BETWEEN 0 AND 3 AND u.portfolio = f.portfolio) AS va,
    (SELECT sum(CASE WHEN v.p = u.p THEN 1 ELSE 2 * (1 - (v.p - u.p) / 4.0) END * u.gb * v.gb) FROM gs u, gs v WHERE u.portfolio = v.portfolio AND v.p - u.p BETWEEN 0 AND 3 AND u.portfolio = f.portfolio) AS vb,
    (SELECT sum(e * e) FROM gs u WHERE u.portfolio = f.portfolio) AS ee FROM fit f)"""
_CAPM_WITH = """
 WITH rows AS (SELECT portfolio, month, ret AS y, mktrf AS x, row_number() OVER (PARTITION BY portfolio ORDER BY month) AS p FROM ({series}) JOIN factors USING (month)),
 fit AS (SELECT portfolio, count(*) AS n, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, avg(x) AS mx FROM rows GROUP BY 1),
 gs AS (SELECT portfolio, p, y - a - b * x AS e, (1.0 / n + mx * mx / sxx - mx / sxx * x) * (y - a - b * x) AS ga, (x - mx) / sxx * (y - a - b * x) AS gb FROM rows JOIN fit USING (portfolio))"""
_LS_CAPM = _CAPM_WITH.format(series="SELECT 'ls' AS portfolio, month, ret FROM ls") + _CAPM


@query("fa_capm_alpha", _LS_CAPM, "alpha alpha_annual t_alpha r2 residual_vol information_ratio beta t_beta")
def fa_capm_alpha(s, d):
    one = _alphas(s, d).where("factor_model = 'CAPM'")
    return one.select("portfolio", "n_months", "alpha", "alpha_annual", "t_alpha", "r2", "residual_vol", "information_ratio", F.get("betas", F.lit(0)).alias("beta"), F.get("t_betas", F.lit(0)).alias("t_beta"))


_FLONG = " UNION ALL ".join(f"SELECT '{f}' AS portfolio, month, month_idx, {f} AS ret FROM factors" for f in T.FACTORS)


@query("fa_factor_measures", measures_sql(f"({_FLONG})"), MEASURES)
def fa_factor_measures(s, d):
    return P.measures(R.factor_series(T.factors(_panel(s, d)), T.FACTORS))


@query("fa_benchmark", f"SELECT month, month_idx, sum(w * ret) / sum(w) AS ret FROM (SELECT month, month_idx, ret, CASE WHEN count(ret) OVER v >= 24 THEN 1 / var_samp(ret) OVER v ELSE 1.0 END AS w FROM ({_FLONG}) WINDOW v AS (PARTITION BY portfolio ORDER BY month_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) GROUP BY 1, 2", "ret")
def fa_benchmark(s, d):
    return R.factor_benchmark(T.factors(_panel(s, d)), T.FACTORS, "inverse_variance")


@query("fa_benchmark_equal", "SELECT month, month_idx, (mktrf + smb + hml + rmw + cma + mom) / 6 AS ret FROM factors", "ret")
def fa_benchmark_equal(s, d):
    return R.factor_benchmark(T.factors(_panel(s, d)), T.FACTORS)


_FBENCH = "SELECT 'benchmark' AS portfolio, month, (mktrf + smb + hml + rmw + cma + mom) / 6 AS ret FROM factors"
_FALL = f"SELECT 'ls' AS portfolio, month, ret FROM ls UNION ALL SELECT portfolio, month, ret FROM ({_FBENCH}) WHERE month IN (SELECT month FROM ls) UNION ALL SELECT portfolio, month, ret FROM ({_FLONG}) WHERE month IN (SELECT month FROM ls)"


_FALPHA = f"SELECT portfolio, 12 * regr_intercept(ret, mktrf) AS alpha_annual FROM (SELECT 'ls' AS portfolio, month, ret FROM ls UNION ALL {_FBENCH}) JOIN factors USING (month) GROUP BY 1"
_FKIND = "CASE portfolio WHEN 'ls' THEN 'model' WHEN 'benchmark' THEN 'benchmark' ELSE 'factor' END AS kind, CASE portfolio WHEN 'ls' THEN 1 WHEN 'benchmark' THEN 2 ELSE 3 END AS k"


@query("fa_comparison", f"SELECT * EXCLUDE (k), row_number() OVER (ORDER BY k, sharpe DESC NULLS LAST, portfolio) AS place FROM (SELECT *, {_FKIND} FROM ({measures_sql('(' + _FALL + ')')})) LEFT JOIN ({_FALPHA}) USING (portfolio)", f"{MEASURES} alpha_annual")
def fa_comparison(s, d):
    factors = T.factors(_panel(s, d))
    model = _ls(s, d).withColumn("portfolio", F.lit("ls"))
    bench = R.factor_benchmark(factors, T.FACTORS).withColumn("portfolio", F.lit("benchmark"))
    both = model.select("portfolio", "month", "ret").unionByName(bench.select("portfolio", "month", "ret"))
    alphas = R.one_factor(both, factors).withColumn("alpha_annual", 12 * F.col("alpha"))
    return R.compare_to_factors(model, bench, R.factor_series(factors, T.FACTORS), alphas)


@query("fa_net_alphas")
def fa_net_alphas(s, d):
    """Factor alphas of gross and net returns, equal and size-weighted, and which lose their significance."""
    df, factors = _dec(s, d, "l_suppkey"), T.factors(_panel(s, d, "l_suppkey"))
    both = C.weightings(df, {"equal": None, "weighted": "cap"}, "portfolio")
    rows = C.long_short_with_costs(both, 10, 100, weight="weight", by=["portfolio"]).select("portfolio", "month", F.col("ret").alias("gross"), "net")
    gross, net = (R.factor_alphas(rows.select("portfolio", "month", F.col(c).alias("ret")), factors) for c in ("gross", "net"))
    lost = R.lost_significance(gross, net).select("portfolio", "factor_model", F.lit(True).alias("lost"))
    both = gross.select("portfolio", "factor_model", F.col("alpha_annual").alias("gross_alpha"), F.col("t_alpha").alias("t_gross")).join(net.select("portfolio", "factor_model", F.col("alpha_annual").alias("net_alpha"), F.col("t_alpha").alias("t_net")), ["portfolio", "factor_model"])
    return both.join(lost, ["portfolio", "factor_model"], "left").withColumn("lost", F.coalesce("lost", F.lit(False)))


@query("fa_verdict", "SELECT portfolio, sharpe, sharpe - (SELECT sharpe FROM (" + measures_sql("(SELECT 'b' AS portfolio, month, (mktrf + smb + hml + rmw + cma + mom) / 6 AS ret FROM factors)") + ")) AS sharpe_gap, coalesce(t_alpha, 0) >= 1.96 AS alpha_significant FROM (" + measures_sql("(SELECT 'ls' AS portfolio, month, ret FROM ls)") + ") LEFT JOIN (" + _LS_CAPM + ") USING (portfolio)", "sharpe sharpe_gap")
def fa_verdict(s, d):
    bench = P.measures(R.factor_benchmark(T.factors(_panel(s, d)), T.FACTORS).withColumn("portfolio", F.lit("b"))).select("sharpe")
    models = P.measures(_ls(s, d).withColumn("portfolio", F.lit("ls")))
    return R.verdict(models, bench, _alphas(s, d).where("factor_model = 'CAPM'"))


@query("fa_coverage", "SELECT month FROM panel WHERE month_idx % 9 = 0 GROUP BY 1")
def fa_coverage(s, d):
    return R.factor_coverage(_panel(s, d).withColumn("portfolio", F.lit("x")), T.factors(_panel(s, d)).where("month_idx % 9 <> 0"))[1]
