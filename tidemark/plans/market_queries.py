"""Queries on market builders and dated facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import portfolio, recipes, sweeps
from ..operators.panel import ret
from ..sources import long_table, markets
from .base import WT, bars, panel, query, r, rank_cte, roll, sql, table
from .portfolio_queries import BOOK

_RATES = "sc AS (SELECT * FROM (VALUES (DATE '1990-01-01', 'a', 30.0::DOUBLE), (DATE '1997-04-07', 'a', 25.0), (DATE '1990-01-01', 'b', 20.0), (DATE '1999-02-01', 'b', 35.0)) x(d, m, v))"


@query(sql("""SELECT t, ticker, coalesce((SELECT max_by(v, d) FROM sc WHERE sc.m = z.m AND d <= date), (SELECT max(v) FROM (SELECT max_by(v, d) AS v FROM sc WHERE d <= date GROUP BY m))) AS rate
FROM (SELECT *, CASE CAST(substring(ticker, 2) AS INT) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS m FROM panel) z""", _RATES))
def sell_tax_asof(spark, sf_dir):
    k = F.expr("CAST(substring(ticker, 2) AS INT) % 3")
    cells = panel(spark, sf_dir).df.select("t", "date", "ticker", F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("market"))
    schedule = spark.sql("SELECT * FROM VALUES (DATE '1990-01-01', 'a', 30.0D), (DATE '1997-04-07', 'a', 25.0D), (DATE '1990-01-01', 'b', 20.0D), (DATE '1999-02-01', 'b', 35.0D) AS x(effective_date, market, value)")
    return markets.sell_tax(cells, schedule).select("t", "ticker", "rate")


@query("""WITH c AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS close FROM orders GROUP BY 1, 2), s AS (SELECT ticker, date, 100 + ticker % 7 + year(date) AS shares FROM c WHERE month(date) IN (1, 7))
SELECT c.ticker, c.date, round(c.close * s.shares, 2) AS mkt_cap FROM c ASOF LEFT JOIN s ON c.ticker = s.ticker AND c.date >= s.date""")
def market_cap_asof(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("close"))
    s = c.where(F.month("date").isin(1, 7)).select("ticker", "date", (100 + F.col("ticker") % 7 + F.year("date")).alias("shares"))
    return markets.market_cap(c, s).select("ticker", "date", r("mkt_cap", 2).alias("mkt_cap"))


@query(sql(f"SELECT t, ticker, round(5.0 + greatest(2.0, 0.25 / close * 1e4) + CASE WHEN coalesce(m < 30000, true) THEN 10.0 ELSE 0.0 END, 8) AS cost FROM (SELECT *, {roll('median(close * volume)', 12, 6)} AS m FROM panel)"))
def liquidity_cost(spark, sf_dir):
    df = panel(spark, sf_dir).df.withColumn("tick", F.lit(0.5))
    return df.select("t", "ticker", r(markets.liquidity_cost_bp(window=12, thin=30000.0, tick="tick")).alias("cost"))


@query(sql("SELECT b.ticker, b.date, t2.sid FROM bars b JOIN (SELECT ticker, date, CASE WHEN g = 0 THEN ticker ELSE ticker || '~' || CAST(g AS VARCHAR) END AS sid FROM (SELECT *, sum(CASE WHEN gap > 28 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date) AS g FROM (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY ticker ORDER BY date), date) AS gap FROM bars))) t2 ON b.ticker = t2.ticker AND b.date = t2.date"))
def split_reused_codes(spark, sf_dir):
    return long_table.split_reused_codes(bars(spark, sf_dir).select("ticker", "date"), 28).select("ticker", "date", "sid")


@query(sql("SELECT ticker, date, round(100 * product(1 + coalesce(r, 0)) OVER (PARTITION BY ticker ORDER BY date), 6) AS adjusted FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars)"))
def chain_linked(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("r", C.div("close", F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))) - 1).withColumn("sid", F.col("ticker"))
    return long_table.chain_linked(b, "r").select("ticker", "date", r("adjusted", 6).alias("adjusted"))


def _book(spark, sf_dir):
    p = panel(spark, sf_dir)
    df = portfolio.one_bar(p).withColumn("ret1", ret(1)).withColumn("factor", recipes.reversal(5))
    return p, portfolio.holdings(p, "factor", 0.2, 0.2, 4, df=df).select("t", "ticker", (F.col("hl") - F.col("hs")).alias("h"))


_LIQUID = BOOK + f", lq AS (SELECT *, {roll('stddev_samp(ret1)', 20, 10)} AS s, {roll('avg(close * volume)', 30)} AS adv FROM tr)"


@query(sql("""SELECT aum, y, round(avg(cost), 10) AS cost, round(avg(gross - cost), 8) + 0.0 AS net FROM (SELECT aum, y, t, sum(CASE WHEN d <> 0 THEN abs(d) * coalesce(least(y * s * sqrt(abs(d) * aum / nullif(adv, 0)), 0.01), 0.01) ELSE 0 END) AS cost, sum(h * fwd1) AS gross
FROM lq, (SELECT unnest([1e4::DOUBLE, 1e5, 1e6]) AS aum), (SELECT unnest([0.5::DOUBLE, 1.0]) AS y) GROUP BY aum, y, t) GROUP BY aum, y""", _LIQUID))
def capacity_curve(spark, sf_dir):
    p, h = _book(spark, sf_dir)
    return sweeps.capacity_curve(p, h, [1e4, 1e5, 1e6], (0.5, 1.0)).select("aum", "y", r("cost", 10).alias("cost"), r("net").alias("net"))


@query(sql("SELECT round(quantile_cont(p, 0.5), 8) AS p50, round(quantile_cont(p, 0.95), 8) AS p95, round(quantile_cont(p, 0.99), 8) AS p99, round(1000.0 / quantile_cont(p, 0.95), 4) AS aum_at_1pct FROM (SELECT abs(d) * 1e5 / nullif(adv, 0) AS p FROM lq WHERE abs(d) > 1e-12)", _LIQUID))
def participation(spark, sf_dir):
    p, h = _book(spark, sf_dir)
    x = sweeps.participation(p.df, h, 1e5)
    return x.select(*(r(c).alias(c) for c in ("p50", "p95", "p99")), r("aum_at_1pct", 4).alias("aum_at_1pct"))


@query()
def factor_permutation(spark, sf_dir):
    return sweeps.factor_permutation(panel(spark, sf_dir), recipes.reversal(5), 20, long_q=0.2, short_q=0.2, hold=4)


@query()
def signal_permutation(spark, sf_dir):
    return sweeps.signal_permutation(panel(spark, sf_dir), F.col("ret1") < -0.2, 4, 10.0, n=20)


_STYLES = f"""sy AS (SELECT *, coalesce(lead(ret1, 2) OVER ({WT}), 0) AS fwd1, {{'illiquidity': CASE WHEN {roll('avg(close * volume)', 30, 20)} > 0 THEN -({roll('avg(close * volume)', 30, 20)}) END, 'lowvol': -({roll('stddev_samp(ret1)', 60, 40)}), 'momentum': lag(close, 4) OVER ({WT}) / nullif(lag(close, 52) OVER ({WT}), 0) - 1, 'reversal': -(close / nullif(lag(close, 5) OVER ({WT}), 0) - 1), 'size': CASE WHEN mkt_cap > 0 THEN -mkt_cap END}} AS f FROM panel),
sx AS (SELECT t, ticker, eligible, fwd1, n AS style, CASE n WHEN 'illiquidity' THEN f.illiquidity WHEN 'lowvol' THEN f.lowvol WHEN 'momentum' THEN f.momentum WHEN 'reversal' THEN f.reversal ELSE f.size END AS x FROM sy, (SELECT unnest(['illiquidity', 'lowvol', 'momentum', 'reversal', 'size']) AS n)),
{rank_cte('sr', 'sx', 'x', 'eligible', 'style, t')},
sw AS (SELECT *, coalesce((CASE WHEN pr >= 1 - 0.3::DOUBLE THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN pr >= 1 - 0.3::DOUBLE THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY style, t), 0), 0) - coalesce((CASE WHEN pr <= 0.3::DOUBLE THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN pr <= 0.3::DOUBLE THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY style, t), 0), 0) AS w FROM sr),
sh AS (SELECT *, sum(w) OVER (PARTITION BY style, ticker ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / least(5, t + 1) AS h FROM sw),
sd AS (SELECT style, t, CASE WHEN count(*) FILTER (eligible AND x IS NOT NULL) >= 10 THEN sum(h * fwd1) END AS r FROM sh GROUP BY style, t),
mk AS (SELECT t, avg(f) AS market FROM (SELECT *, lead(close, 2) OVER ({WT}) / nullif(lead(close, 1) OVER ({WT}), 0) - 1 AS f FROM panel) WHERE eligible GROUP BY t)"""


@query(sql("SELECT t, round(any_value(market), 8) + 0.0 AS market, " + ", ".join(f"round(max(r) FILTER (style = '{n}'), 8) + 0.0 AS {n}" for n in ("illiquidity", "lowvol", "momentum", "reversal", "size")) + " FROM sd LEFT JOIN mk USING (t) WHERE t < (SELECT max(t) - 1 FROM panel) GROUP BY t", _STYLES))
def style_returns(spark, sf_dir):
    s = sweeps.style_returns(panel(spark, sf_dir))
    return s.select("t", *(r(c).alias(c) for c in s.columns[1:]))


@query(sql(
    f"""SELECT x.lag, t, round(CASE x.lag WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE g3 END - d * 10 / 2e4, 8) + 0.0 AS net FROM (SELECT t, sum(d) AS d, sum((hl - hs) * f1) AS g1, sum((hl - hs) * f2) AS g2, sum((hl - hs) * f3) AS g3 FROM
(SELECT t, hl, hs, abs(coalesce(hl - lag(hl) OVER ({WT}), 0)) + abs(coalesce(hs - lag(hs) OVER ({WT}), 0)) AS d, coalesce(lead(ret1, 2) OVER ({WT}), 0) AS f1, coalesce(lead(ret1, 3) OVER ({WT}), 0) AS f2, coalesce(lead(ret1, 4) OVER ({WT}), 0) AS f3 FROM held) GROUP BY t), (SELECT unnest([1, 2, 3]) AS lag) x WHERE t < (SELECT max(t) FROM panel) - x.lag""", BOOK))
def latency_sweep(spark, sf_dir):
    x = sweeps.latency_sweep(panel(spark, sf_dir), recipes.reversal(5), (1, 2, 3), long_q=0.2, short_q=0.2, hold=4, spread_bp=10.0)
    return x.select("lag", "t", r("net").alias("net"))


@query()
def delisting_scenario(spark, sf_dir):
    return sweeps.inject_delistings(panel(spark, sf_dir), 0.1).df.where("delist_after").select("t", "ticker")


@query()
def draw_order(spark, sf_dir):
    return markets.draw_order(panel(spark, sf_dir).df.select("ticker"), 7)
