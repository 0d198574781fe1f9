"""Registry of queries and of the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.functions.keys import rounded
from panelspark.sources.testpanel import factors_sql, panel_sql, predictions_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = "", panel: str | None = "l_partkey", digits: int = 6):
    """Registers a query; ``doubles`` are the columns that both sides round to ``digits``.

    More digits where values lie halfway between two numbers of six.
    """

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            ORACLE[name] = oracle(sql, doubles, panel, digits)
        return f

    return add


def oracle(sql: str, doubles: str = "", panel: str | None = "l_partkey", digits: int = 6) -> str:
    """The SQL with the panel, deciles and their kin as common tables, and rounded doubles."""
    head = ""
    if panel:
        parts = [f"panel AS ({panel_sql(panel)})"] + [f"{n} AS ({q})" for n, q in COMMON.items() if n in _needed(sql)]
        head = "WITH " + ",\n".join(parts) + "\n"
    names = doubles.split()
    body = f"SELECT * REPLACE ({', '.join(f'round({n}, {digits}) + 0.0 AS {n}' for n in names)}) FROM ({sql})" if names else sql
    return head + body


def _needed(sql: str) -> set[str]:
    """Common tables that the SQL uses, with those that they use."""
    found: set[str] = set()
    texts = [sql]
    while texts:
        text = texts.pop()
        for name, q in COMMON.items():
            if name not in found and name in text.replace("(", " ").replace(")", " ").replace(",", " ").split():
                found.add(name)
                texts.append(q)
    return found


def measures_sql(series: str) -> str:
    """Performance of ``series`` (portfolio, month, ret), without the p-value."""
    return f"""
 SELECT portfolio, n_months,
  CASE WHEN n_months >= 2 THEN m * 12 END AS mean_annual, CASE WHEN n_months >= 2 THEN s * sqrt(12) END AS volatility_annual,
  CASE WHEN n_months >= 2 AND s > 0 THEN m * 12 / (s * sqrt(12)) END AS sharpe, CASE WHEN n_months >= 2 AND d > 0 THEN m * 12 / (d * sqrt(12)) END AS sortino,
  CASE WHEN n_months >= 2 THEN dd END AS max_drawdown, CASE WHEN n_months >= 2 THEN pos END AS share_positive,
  CASE WHEN n_months >= 2 AND s > 0 THEN m / (s / sqrt(n_months)) END AS t_stat, CASE WHEN n_months >= 2 THEN sk END AS skewness, CASE WHEN n_months >= 2 THEN ku END AS kurtosis
 FROM (SELECT portfolio, count(*) AS n_months, avg(ret) AS m, stddev_samp(ret) AS s, sqrt(avg(least(ret, 0) ** 2)) AS d, min(w / peak - 1) AS dd, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS pos,
   (avg(ret ** 3) - 3 * avg(ret) * avg(ret ** 2) + 2 * avg(ret) ** 3) / (avg(ret ** 2) - avg(ret) ** 2) ** 1.5 AS sk, kurtosis_pop(ret) AS ku
  FROM (SELECT *, max(w) OVER (PARTITION BY portfolio ORDER BY month ROWS UNBOUNDED PRECEDING) AS peak
   FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio ORDER BY month ROWS UNBOUNDED PRECEDING)) AS w FROM {series} WHERE ret IS NOT NULL)) GROUP BY portfolio)"""


MEASURES = "mean_annual volatility_annual sharpe sortino max_drawdown share_positive t_stat skewness kurtosis"


def decile_sql(source: str, signal: str, by: str = "month", n: int = 10) -> str:
    return f"""
 SELECT * EXCLUDE (r_, n_), CASE WHEN n_ >= {n} THEN CAST(greatest(1, ((r_ - 1) * {n} + n_ - 2) // greatest(n_ - 1, 1)) AS INT) END AS decile
 FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {signal}, entity) AS r_, count(*) OVER (PARTITION BY {by}) AS n_ FROM {source} WHERE {signal} IS NOT NULL)"""


#: Tables that several oracles share, each from the panel or an earlier one.
COMMON = {
    "factors": factors_sql(),
    "preds": predictions_sql(),
    "macro": "SELECT month, month_idx, min(rf) AS rf, CAST(sum(CAST(round(cap * 100) AS BIGINT)) AS BIGINT) AS index_level, count(*) AS n_entities FROM panel GROUP BY 1, 2",
    "ex": "SELECT *, ret - rf AS y FROM panel",
    "dec": decile_sql("ex", "pred_a"),
    "decret": "SELECT month, decile, avg(y) AS ret FROM dec WHERE decile IS NOT NULL GROUP BY 1, 2",
    "decretw": "SELECT month, decile, sum(cap * y) / sum(cap) AS ret FROM dec WHERE decile IS NOT NULL AND cap > 0 GROUP BY 1, 2",
    "ls": "SELECT * FROM (SELECT month, max(CASE WHEN decile = 10 THEN ret END) - max(CASE WHEN decile = 1 THEN ret END) AS ret FROM decret GROUP BY 1) WHERE ret IS NOT NULL",
    "mdec": decile_sql("preds", "prediction", "model, month"),
    "mls": "SELECT * FROM (SELECT model, month, avg(CASE WHEN decile = 10 THEN y END) - avg(CASE WHEN decile = 1 THEN y END) AS ret FROM mdec GROUP BY 1, 2) WHERE ret IS NOT NULL",
    "small": "SELECT p.* FROM panel p JOIN (SELECT month, quantile_cont(cap, 0.1) AS q FROM panel GROUP BY 1) USING (month) WHERE cap >= q",
    "universe": "SELECT s.* FROM small s JOIN (SELECT month, quantile_cont(illiq, 0.9) AS q FROM small GROUP BY 1) USING (month) WHERE illiq <= q",
    "long": "SELECT entity, month, 'f1' AS feature, f1 AS x FROM universe UNION ALL SELECT entity, month, 'f2', f2 FROM universe UNION ALL SELECT entity, month, 'f3', f3 FROM universe",
    "filled1": "SELECT l.entity, l.month, l.feature, coalesce(x, m) AS x FROM long l JOIN (SELECT month, feature, quantile_cont(x, 0.5) AS m FROM long GROUP BY 1, 2) g ON l.month = g.month AND l.feature = g.feature",
    "filled": "SELECT f.entity, f.month, f.feature, coalesce(x, m, 0) AS x FROM filled1 f JOIN (SELECT feature, quantile_cont(x, 0.5) AS m FROM filled1 GROUP BY 1) g USING (feature)",
    "clipped": "SELECT f.entity, f.month, f.feature, least(greatest(x, lo), hi) AS x FROM filled f JOIN (SELECT month, feature, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM filled GROUP BY 1, 2) q ON f.month = q.month AND f.feature = q.feature",
    "ranked": "SELECT entity, month, feature, CASE WHEN n <= 1 THEN 0.0 ELSE 2 * (r + (t - 1) / 2.0 - 1) / (n - 1) - 1 END AS x FROM (SELECT *, rank() OVER (PARTITION BY month, feature ORDER BY x) AS r, count(*) OVER (PARTITION BY month, feature, x) AS t, count(*) OVER (PARTITION BY month, feature) AS n FROM clipped)",
    "grouped": "SELECT p.*, CASE WHEN cap <= a THEN 'small' WHEN cap <= b THEN 'mid' ELSE 'large' END AS size_group FROM ex p JOIN (SELECT month, quantile_cont(cap, 1/3.0) AS a, quantile_cont(cap, 2/3.0) AS b FROM panel GROUP BY 1) USING (month)",
    "ends": "SELECT max(month_idx) AS panel_end FROM panel",
    "spans": "SELECT entity, min(month_idx) AS a, max(month_idx) AS b, count(*) AS n FROM panel GROUP BY 1",
    "grid": "SELECT g.entity, g.month_idx, p.ret, g.month_idx > g.b AS ext, CASE WHEN g.b < panel_end THEN 'delisted' ELSE 'listed_at_end' END AS status, panel_end, m.rf FROM (SELECT entity, b, panel_end, unnest(range(a, least(b + 6, panel_end) + 1)) AS month_idx FROM spans, ends) g LEFT JOIN panel p ON p.entity = g.entity AND p.month_idx = g.month_idx LEFT JOIN macro m ON m.month_idx = g.month_idx",
    "forward": "SELECT entity, month_idx, status, CASE WHEN nr = 6 AND nf = 6 AND month_idx + 6 <= panel_end THEN (exp(sr) - 1) - (exp(sf) - 1) END AS target, n_observed FROM (SELECT *, count(r) OVER w AS nr, count(rf) OVER w AS nf, sum(ln(1 + r)) OVER w AS sr, sum(ln(1 + rf)) OVER w AS sf, CAST(coalesce(sum(CASE WHEN ext THEN 0 ELSE 1 END) OVER w, 0) AS BIGINT) AS n_observed FROM (SELECT *, CASE WHEN CASE WHEN ext THEN rf ELSE ret END IS NOT NULL THEN greatest(CASE WHEN ext THEN rf ELSE ret END, -0.999999) END AS r FROM grid) WINDOW w AS (PARTITION BY entity ORDER BY month_idx RANGE BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) WHERE NOT ext AND ret IS NOT NULL",
    "w": "SELECT leg, month, month_idx, entity, 1.0 / count(*) OVER (PARTITION BY leg, month) AS w, ret AS r FROM (SELECT 'long' AS leg, * FROM dec WHERE decile = 10 UNION ALL SELECT 'short', * FROM dec WHERE decile = 1)",
    "pos": "SELECT leg, month, month_idx, row_number() OVER (PARTITION BY leg ORDER BY month_idx) AS p FROM (SELECT DISTINCT leg, month, month_idx FROM w)",
    "nowt": "SELECT w.leg, p, entity, w FROM w JOIN pos USING (leg, month_idx)",
    "beft": "SELECT w.leg, p + 1 AS p, entity, w * (1 + r) / sum(w * (1 + r)) OVER (PARTITION BY w.leg, w.month_idx) AS d FROM w JOIN pos USING (leg, month_idx)",
    "turn": "SELECT x.leg, pos.month, pos.month_idx, turnover, entries_exits, rebalancing FROM (SELECT coalesce(n.leg, b.leg) AS leg, coalesce(n.p, b.p) AS p, sum(abs(coalesce(w, 0) - coalesce(d, 0))) AS turnover, sum(CASE WHEN coalesce(w, 0) > 0 AND coalesce(d, 0) > 0 THEN 0 ELSE abs(coalesce(w, 0) - coalesce(d, 0)) END) AS entries_exits, sum(CASE WHEN coalesce(w, 0) > 0 AND coalesce(d, 0) > 0 THEN abs(coalesce(w, 0) - coalesce(d, 0)) ELSE 0 END) AS rebalancing FROM nowt n FULL JOIN beft b ON n.leg = b.leg AND n.p = b.p AND n.entity = b.entity GROUP BY 1, 2) x JOIN pos ON pos.leg = x.leg AND pos.p = x.p",
    "cost": "SELECT month, month_idx, sum(turnover) AS turnover, sum(turnover) * 0.001 AS trade_cost, 0.01 / 12 AS borrow_cost, sum(turnover) * 0.001 + 0.01 / 12 AS cost FROM turn GROUP BY 1, 2 HAVING month_idx > (SELECT min(month_idx) FROM turn)",
    "grossw": "SELECT * FROM (SELECT month, month_idx, sum(CASE WHEN leg = 'long' THEN w * r END) - sum(CASE WHEN leg = 'short' THEN w * r END) AS ret FROM w GROUP BY 1, 2) WHERE ret IS NOT NULL",
    "net": "SELECT g.month, g.month_idx, g.ret, c.turnover, c.cost, g.ret - coalesce(c.cost, 0) AS net FROM grossw g LEFT JOIN cost c USING (month)",
    "errs": "SELECT month, month_idx, count(*) AS n, sum(y * y) AS yy, sum(pred_a * y) AS xy_0, sum(pred_b * y) AS xy_1, sum(pred_a * pred_a) AS xx_0_0, sum(pred_a * pred_b) AS xx_0_1, sum(pred_b * pred_b) AS xx_1_1 FROM ex GROUP BY 1, 2",
    "iw": "SELECT month, month_idx, n_past < 24 AS fallback, CASE WHEN n_past >= 24 THEN (1 / ma) / (1 / ma + 1 / mb) ELSE 0.5 END AS wa, CASE WHEN n_past >= 24 THEN (1 / mb) / (1 / ma + 1 / mb) ELSE 0.5 END AS wb FROM (SELECT month, month_idx, count(*) OVER v AS n_past, (sum(yy) OVER v - 2 * sum(xy_0) OVER v + sum(xx_0_0) OVER v) / sum(n) OVER v AS ma, (sum(yy) OVER v - 2 * sum(xy_1) OVER v + sum(xx_1_1) OVER v) / sum(n) OVER v AS mb FROM errs WINDOW v AS (ORDER BY month_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))",
    "years": "SELECT DISTINCT month, month_idx, CAST(substring(month, 1, 4) AS INT) AS year FROM panel",
    "tests": "SELECT row_number() OVER (ORDER BY ty) AS window_id, ty AS test_year, y0, greatest(2 - 1 * greatest(row_number() OVER (ORDER BY ty) - 1, 0), 1) AS v FROM (SELECT min(year) AS y0, unnest(range(min(year) + 5, max(year) + 1)) AS ty FROM years)",
    "win": "SELECT CAST(window_id AS INT) AS window_id, block, month, month_idx, CAST(test_year AS INT) AS test_year FROM (SELECT *, CASE WHEN year >= test_year - v - 3 AND year < test_year - v THEN 'train' WHEN year >= test_year - v AND year < test_year THEN 'validation' WHEN year = test_year THEN 'test' END AS block FROM years, tests) WHERE block IS NOT NULL",
}
