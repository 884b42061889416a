"""Queries on portfolios, costs, events and inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import columns as C
from ..operators import costs, engine, event, execution, portfolio, recipes
from ..operators import panel as P
from .base import WT, panel, query, r, rank_cte, roll, sql, with_ret
from .panel_queries import HALTED, TRADABLE, halted_panel

HOLD = 4
_FACTOR = f"f0 AS (SELECT *, -(close / nullif(lag(close, 5) OVER ({WT}), 0) - 1) AS factor, coalesce(lead(ret1, 2) OVER ({WT}), 0) AS fwd1 FROM panel)"


def _legs(weight_long: str, weight_short: str) -> str:
    return f"""{_FACTOR}, {rank_cte('rk', 'f0', 'factor')},
raw AS (SELECT *, CASE WHEN pr >= 0.8::DOUBLE THEN {weight_long} ELSE 0.0 END AS wl0, CASE WHEN pr <= 0.2::DOUBLE THEN {weight_short} ELSE 0.0 END AS ws0 FROM rk),
leg AS (SELECT *, coalesce(wl0 / nullif(sum(wl0) OVER (PARTITION BY t), 0), 0) AS wl, coalesce(ws0 / nullif(sum(ws0) OVER (PARTITION BY t), 0), 0) AS ws FROM raw),
held AS (SELECT *, sum(wl) OVER w / least({HOLD}, t + 1) AS hl, sum(ws) OVER w / least({HOLD}, t + 1) AS hs FROM leg WINDOW w AS ({WT} ROWS BETWEEN {HOLD - 1} PRECEDING AND CURRENT ROW))"""


_EQUAL = _legs("1.0::DOUBLE", "1.0::DOUBLE")
_DAILY = f"""{_EQUAL},
mv AS (SELECT *, abs(coalesce(hl - lag(hl) OVER ({WT}), 0)) + abs(coalesce(hs - lag(hs) OVER ({WT}), 0)) AS d FROM held),
net AS (SELECT t, date, sum((hl - hs) * fwd1) AS gross, sum(d) * 10 / 2e4 AS cost, sum(d) / 2 AS turnover, sum((hl - hs) * fwd1) - sum(d) * 10 / 2e4 AS net FROM mv GROUP BY t, date HAVING t < (SELECT max(t) - 1 FROM panel)),
bm AS (SELECT t, avg(fwd1) AS bench FROM f0 WHERE eligible GROUP BY t)"""


def _factors(p):
    return portfolio.one_bar(p).withColumn("ret1", P.ret(1)).withColumn("factor", recipes.reversal(5))


def _held(p, weighting="equal"):
    return portfolio.holdings(p, "factor", 0.2, 0.2, HOLD, weighting, _factors(p))


def _net(spark, sf_dir):
    p = panel(spark, sf_dir)
    return portfolio.backtest_portfolio(p, "factor", long_q=0.2, short_q=0.2, hold=HOLD, spread_bp=10.0, df=_factors(p))


def _both(spark, sf_dir):
    p = panel(spark, sf_dir)
    return _net(spark, sf_dir).join(portfolio.benchmark(_factors(p)), "t")


def _leg_query(name, weighting, long, short):
    def run(spark, sf_dir):
        return _held(panel(spark, sf_dir), weighting).select("t", "ticker", r("hl").alias("hl"), r("hs").alias("hs"))

    query(sql("SELECT t, ticker, round(hl, 8) AS hl, round(hs, 8) AS hs FROM held", _legs(long, short)), name)(run)


_leg_query("leg_weights_equal", "equal", "1.0::DOUBLE", "1.0::DOUBLE")
_leg_query("leg_weights_rank", "rank", "pr - (1 - 0.2::DOUBLE)", "0.2::DOUBLE - pr")
_leg_query("leg_weights_signal", "signal", "abs(factor)", "abs(factor)")


@query(sql("SELECT t, date, round(gross, 8) + 0.0 AS gross, round(cost, 10) AS cost, round(turnover, 8) AS turnover, round(net, 8) + 0.0 AS net FROM net", _DAILY))
def portfolio_net(spark, sf_dir):
    return _net(spark, sf_dir).select("t", "date", r("gross").alias("gross"), r("cost", 10).alias("cost"), r("turnover").alias("turnover"), r("net").alias("net"))


_DD = ", eq AS (SELECT *, product(1 + net) OVER (ORDER BY t) AS equity FROM net), dd AS (SELECT *, equity / greatest(max(equity) OVER (ORDER BY t), 1.0::DOUBLE) - 1 AS drawdown FROM eq)"


@query(sql("SELECT t, round(equity, 8) AS equity, round(drawdown, 8) + 0.0 AS drawdown FROM dd", _DAILY + _DD))
def drawdown(spark, sf_dir):
    return stats.drawdown(_net(spark, sf_dir)).select("t", r("equity").alias("equity"), r("drawdown").alias("drawdown"))


@query(sql("""SELECT count(net) AS n, round(CASE WHEN product(1 + net) > 0 THEN power(product(1 + net), 52.0 / count(net)) - 1 ELSE -1.0 END, 8) AS cagr, round(stddev_samp(net) * sqrt(52), 8) AS vol, round(avg(net) / stddev_samp(net) * sqrt(52), 8) AS sharpe,
round(avg(net) / sqrt(avg(CASE WHEN net < 0 THEN net * net ELSE 0 END)) * sqrt(52), 8) AS sortino, round(min(drawdown), 8) AS mdd, round((CASE WHEN product(1 + net) > 0 THEN power(product(1 + net), 52.0 / count(net)) - 1 ELSE -1.0 END) / -min(drawdown), 8) AS calmar, round(avg(CAST(net > 0 AS INT)), 8) AS pos_days FROM dd""", _DAILY + _DD))
def portfolio_metrics(spark, sf_dir):
    m = stats.metrics(_net(spark, sf_dir), 52)
    return m.select("n", *(r(c).alias(c) for c in m.columns[1:]))


@query(sql("SELECT CAST(date_trunc('year', date) AS DATE) AS period, round(product(1 + net) - 1, 8) + 0.0 AS ret FROM net GROUP BY 1", _DAILY))
def yearly_returns(spark, sf_dir):
    return stats.period_returns(_net(spark, sf_dir), "year").select("period", r("ret").alias("ret"))


@query(sql("SELECT CAST(date_trunc('month', date) AS DATE) AS period, round(product(1 + net) - 1, 8) + 0.0 AS ret FROM net GROUP BY 1", _DAILY))
def monthly_returns(spark, sf_dir):
    return stats.period_returns(_net(spark, sf_dir), "month").select("period", r("ret").alias("ret"))


@query(sql("SELECT t, round(bench, 8) + 0.0 AS bench FROM bm", _DAILY))
def benchmark_equal(spark, sf_dir):
    return portfolio.benchmark(_factors(panel(spark, sf_dir))).select("t", r("bench").alias("bench"))


@query(sql("SELECT t, round(sum(coalesce(mkt_cap, 0) * fwd1) / nullif(sum(coalesce(mkt_cap, 0)), 0), 8) + 0.0 AS bench FROM f0 WHERE eligible GROUP BY t", _FACTOR))
def benchmark_cap(spark, sf_dir):
    return portfolio.benchmark(_factors(panel(spark, sf_dir)), "cap").select("t", r("bench").alias("bench"))


_BOTH = _DAILY + ", nb AS (SELECT net.t, date, net, bench, product(1 + net) OVER (ORDER BY net.t) / product(1 + bench) OVER (ORDER BY net.t) AS q FROM net JOIN bm ON net.t = bm.t)"


@query(sql("""SELECT count(*) AS n, round(covar_samp(net, bench) / var_samp(bench), 8) AS beta, round(corr(net, bench), 8) AS corr, round(stddev_samp(net - bench) * sqrt(52), 8) AS te, round(avg(net - bench) / stddev_samp(net - bench) * sqrt(52), 8) AS ir,
round(avg(CAST(net > bench AS INT)), 8) AS hit, round(avg(net) FILTER (bench > 0) / avg(bench) FILTER (bench > 0), 8) AS up_capture, round(avg(net) FILTER (bench < 0) / avg(bench) FILTER (bench < 0), 8) AS down_capture,
round((CASE WHEN product(1 + net) > 0 THEN power(product(1 + net), 52.0 / count(*)) - 1 ELSE -1.0 END), 8) AS cagr, round((CASE WHEN product(1 + bench) > 0 THEN power(product(1 + bench), 52.0 / count(*)) - 1 ELSE -1.0 END), 8) AS bench_cagr, round((CASE WHEN product(1 + net) > 0 THEN power(product(1 + net), 52.0 / count(*)) - 1 ELSE -1.0 END) - (CASE WHEN product(1 + bench) > 0 THEN power(product(1 + bench), 52.0 / count(*)) - 1 ELSE -1.0 END), 8) AS excess_cagr,
(SELECT round(avg(CAST(a > b AS INT)), 8) FROM (SELECT product(1 + net) AS a, product(1 + bench) AS b FROM nb GROUP BY date_trunc('month', date))) AS hit_month, (SELECT round(avg(CAST(a > b AS INT)), 8) FROM (SELECT product(1 + net) AS a, product(1 + bench) AS b FROM nb GROUP BY year(date))) AS hit_year,
(SELECT round(min(f), 8) FROM (SELECT q / greatest(max(q) OVER (ORDER BY t), 1.0::DOUBLE) - 1 AS f FROM nb)) AS max_relative_drawdown FROM nb""", _BOTH))
def market_relative(spark, sf_dir):
    m = stats.market_relative(_both(spark, sf_dir), 52)
    return m.select("n", *(r(c).alias(c) for c in m.columns[1:]))


_MOMENTS = "avg(power(net - m, 3)) / power(avg(power(net - m, 2)), 1.5) AS skew, avg(power(net - m, 4)) / power(avg(power(net - m, 2)), 2) AS kurtosis"


_CAGR = "(CASE WHEN product(1 + net) > 0 THEN power(product(1 + net), 52.0 / count(net)) - 1 ELSE -1.0 END)"


@query(sql(f"""SELECT count(net) AS n, round(product(1 + net) - 1, 8) AS total_return, round(max(q05), 8) AS var_95, round(max(q01), 8) AS var_99, round(avg(net) FILTER (net <= q05), 8) AS cvar_95, round(avg(net) FILTER (net <= q01), 8) AS cvar_99, round(avg(net) - 1.6448536269514722 * stddev_samp(net), 8) AS var_95_normal,
round(CASE WHEN max(q05) < 0 THEN max(q95) / abs(max(q05)) END, 8) AS tail_ratio, round(max(net), 8) AS best_bar, round(min(net), 8) AS worst_bar, round(any_value(sk), 4) AS skew, round(any_value(ku), 4) AS kurtosis,
(SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM (SELECT t - row_number() OVER (ORDER BY t) AS g FROM dd WHERE drawdown < -1e-12) GROUP BY g)) AS max_dd_bars, round(avg(CAST(drawdown < -1e-12 AS INT)), 8) AS share_underwater, round(sqrt(avg(drawdown * drawdown)), 8) AS ulcer_index,
round({_CAGR} / sqrt(avg(drawdown * drawdown)), 8) AS ulcer_performance, round(sum(net) / -sum(CASE WHEN net < 0 THEN net ELSE 0 END), 8) AS gain_to_pain, (SELECT round(max(m), 8) FROM (SELECT product(1 + net) - 1 AS m FROM net GROUP BY date_trunc('month', date))) AS best_month, (SELECT round(min(m), 8) FROM (SELECT product(1 + net) - 1 AS m FROM net GROUP BY date_trunc('month', date))) AS worst_month
FROM dd, (SELECT quantile_cont(net, 0.01) AS q01, quantile_cont(net, 0.05) AS q05, quantile_cont(net, 0.95) AS q95 FROM net), (SELECT {_MOMENTS.replace('AS skew', 'AS sk').replace('AS kurtosis', 'AS ku')} FROM net, (SELECT avg(net) AS m FROM net))""", _DAILY + _DD))
def risk_profile(spark, sf_dir):
    p = stats.risk_profile(_net(spark, sf_dir), 52)
    return p.select("n", "max_dd_bars", *(r(c, 4 if c in ("skew", "kurtosis") else 8).alias(c) for c in p.columns if c not in ("n", "max_dd_bars")))


@query(sql("SELECT CAST(min(mdd) AS DOUBLE) AS mdd, any_value(tt) AS trough_t, coalesce(max(CASE WHEN t < tt AND equity >= hi * (1 - 1e-12) THEN t END), -1) AS peak_t, min(CASE WHEN t > tt AND equity >= hi * (1 - 1e-12) THEN t END) AS recovery_t FROM dd, (SELECT t AS tt, round(drawdown, 8) AS mdd, equity / (1 + drawdown) AS hi FROM dd ORDER BY drawdown, t LIMIT 1)", _DAILY + _DD))
def drawdown_dates(spark, sf_dir):
    return stats.drawdown_dates(_net(spark, sf_dir)).select(r("mdd").alias("mdd"), "trough_t", "peak_t", "recovery_t")


@query(sql("""SELECT year, round(product(1 + net) - 1, 8) AS ret, round(stddev_samp(net) * sqrt(52), 8) AS vol, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52), 8) AS sharpe, round(min(f), 8) + 0.0 AS max_dd, count(*) AS bars
FROM (SELECT *, e / greatest(max(e) OVER (PARTITION BY year ORDER BY t), 1.0::DOUBLE) - 1 AS f FROM (SELECT *, year(date) AS year, product(1 + net) OVER (PARTITION BY year(date) ORDER BY t) AS e FROM net)) GROUP BY year""", _DAILY))
def subperiods(spark, sf_dir):
    s = stats.subperiods(_net(spark, sf_dir), 52)
    return s.select(F.col("year").cast("long").alias("year"), *(r(c).alias(c) for c in ("ret", "vol", "sharpe", "max_dd")), "bars")


@query(sql("SELECT half, round(avg(net) / stddev_samp(net) * sqrt(52), 8) AS sharpe FROM (SELECT net, CASE WHEN row_number() OVER (ORDER BY t) <= floor(count(*) OVER () / 2) THEN 1 ELSE 2 END AS half FROM net) GROUP BY half", _DAILY))
def halves(spark, sf_dir):
    return stats.halves(_net(spark, sf_dir), 52).select("half", r("sharpe").alias("sharpe"))


@query(sql("SELECT t, round(CASE WHEN count(net) OVER w >= 26 THEN avg(net) OVER w / nullif(stddev_samp(net) OVER w, 0) * sqrt(52) END, 7) AS sharpe FROM net WINDOW w AS (ORDER BY t ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)", _DAILY))
def rolling_sharpe(spark, sf_dir):
    return stats.rolling_sharpe(_net(spark, sf_dir), 26, 52).select("t", r("sharpe", 7).alias("sharpe"))


@query(sql("SELECT round((mb - ma) / sqrt(va / na + vb / nb), 7) AS mean_diff_t, round((mb / sqrt(vb)) / (ma / sqrt(va)), 7) AS sharpe_ratio FROM (SELECT avg(net) AS ma, var_samp(net) AS va, count(*) AS na FROM net WHERE date < DATE '1999-01-01'), (SELECT avg(net) AS mb, var_samp(net) AS vb, count(*) AS nb FROM net WHERE date >= DATE '1999-01-01')", _DAILY))
def in_out_of_sample(spark, sf_dir):
    import datetime

    d = stats.in_out_of_sample(_net(spark, sf_dir), datetime.date(1999, 1, 1), 52)
    return spark.createDataFrame([(round(d["mean_diff_t"], 7), round(d["sharpe_ratio"], 7))], "mean_diff_t double, sharpe_ratio double")


@query(sql(f"SELECT count(net) AS n, round(avg(net), 8) + 0.0 AS mean, round(avg(net) / stddev_samp(net) * sqrt(count(net)), 8) AS t, count(*) FILTER (net > 0) AS up, count(*) FILTER (net = 0) AS zero, round(any_value(sk), 4) AS skew, round(any_value(ku), 4) AS kurtosis FROM net, (SELECT {_MOMENTS.replace('AS skew', 'AS sk').replace('AS kurtosis', 'AS ku')} FROM net, (SELECT avg(net) AS m FROM net))", _DAILY))
def mean_tests_moments(spark, sf_dir):
    m = stats.mean_tests(_net(spark, sf_dir))
    return m.select("n", r("mean").alias("mean"), r("t").alias("t"), "up", "zero", r("skew", 4).alias("skew"), r("kurtosis", 4).alias("kurtosis"))


_NW = """nw0 AS (SELECT t, net, net - avg(net) OVER () AS e, count(*) OVER () AS n, row_number() OVER (ORDER BY t) AS k FROM net),
nw AS (SELECT any_value(n) AS n, avg(net) AS mean, sqrt(sum(e * e) + (SELECT sum(2 * (1 - (a.k - b.k) / 7.0::DOUBLE) * a.e * b.e) FROM nw0 a JOIN nw0 b ON a.k - b.k BETWEEN 1 AND 6)) / any_value(n) AS se FROM nw0)"""


@query(sql("SELECT n, round(mean, 8) + 0.0 AS mean, round(se, 8) AS se, round(mean / se, 8) AS t FROM nw", _DAILY + ", " + _NW))
def newey_west(spark, sf_dir):
    return stats.newey_west(_net(spark, sf_dir), "net", 6).select("n", r("mean").alias("mean"), r("se").alias("se"), r("t").alias("t"))


_REGIME = """rg0 AS (SELECT t, net, bench, product(1 + bench) OVER (ORDER BY t) AS eq, product(1 + bench) OVER (PARTITION BY date_trunc('month', date)) - 1 AS mo, CASE WHEN count(bench) OVER w >= 26 THEN stddev_samp(bench) OVER w END AS vol FROM nb WINDOW w AS (ORDER BY t ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
rg1 AS (SELECT *, eq / greatest(max(eq) OVER (ORDER BY t), 1.0::DOUBLE) - 1 AS fall FROM rg0), rq AS (SELECT quantile_cont(vol, 1.0 / 3) AS a, quantile_cont(vol, 2.0 / 3) AS b FROM rg1),
rg AS (SELECT CASE WHEN fall <= -0.2 THEN 'bear' ELSE 'other' END AS regime, net FROM rg1 UNION ALL SELECT CASE WHEN mo > 0 THEN 'rose' ELSE 'fell' END, net FROM rg1 UNION ALL SELECT 'calm', net FROM rg1, rq WHERE vol <= a UNION ALL SELECT 'stormy', net FROM rg1, rq WHERE vol >= b)"""


@query(sql("SELECT regime, count(*) AS n, round(count(*) / (SELECT count(*) FROM nb), 8) AS share, round(avg(net) * 52, 7) + 0.0 AS mean_annual, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52), 7) + 0.0 AS sharpe, round(avg(CAST(net > 0 AS INT)), 8) AS win FROM rg GROUP BY regime HAVING count(*) >= 20", _BOTH + ", " + _REGIME))
def regimes(spark, sf_dir):
    x = stats.regimes(_both(spark, sf_dir), window=26, periods=52)
    return x.select("regime", "n", r("share").alias("share"), r("mean_annual", 7).alias("mean_annual"), r("sharpe", 7).alias("sharpe"), r("win").alias("win"))


_GRID_COSTS, _GRID_HOLDS = (0.0, 10.0, 20.0), (1, 4, 10)


def _grid_sql() -> str:
    parts = []
    for k in _GRID_HOLDS:
        w = f"OVER ({WT} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) / least({k}, t + 1)"
        parts.append(f"SELECT {k} AS hold, t, ticker, fwd1, sum(wl) {w} AS hl, sum(ws) {w} AS hs FROM leg")
    return f"""gh AS ({' UNION ALL '.join(parts)}), gd AS (SELECT *, abs(coalesce(hl - lag(hl) OVER (PARTITION BY hold, ticker ORDER BY t), 0)) + abs(coalesce(hs - lag(hs) OVER (PARTITION BY hold, ticker ORDER BY t), 0)) AS d FROM gh),
gs AS (SELECT hold, t, sum((hl - hs) * fwd1) AS g, sum(d) AS d FROM gd GROUP BY hold, t HAVING t < (SELECT max(t) - 1 FROM panel)),
grid AS (SELECT hold, cost_bp, t, g - d * cost_bp / 2e4 AS net FROM gs, (SELECT unnest([0.0::DOUBLE, 10.0, 20.0]) AS cost_bp))"""


def _grid(spark, sf_dir):
    p = panel(spark, sf_dir)
    return portfolio.grid(p, "factor", _GRID_HOLDS, _GRID_COSTS, 0.2, 0.2, _factors(p))


_GRID = _EQUAL + ", " + _grid_sql()


@query(sql("SELECT hold, cost_bp, count(*) AS n, round(avg(net), 8) + 0.0 AS mean, round(avg(net) / stddev_samp(net) * sqrt(52), 8) AS sharpe FROM grid GROUP BY hold, cost_bp", _GRID))
def portfolio_grid(spark, sf_dir):
    return _grid(spark, sf_dir).groupBy("hold", "cost_bp").agg(F.count("*").alias("n"), r(F.avg("net")).alias("mean"), r(F.avg("net") / F.stddev_samp("net") * 52**0.5).alias("sharpe"))


def _trials(spark, sf_dir):
    return _grid(spark, sf_dir).select((F.col("hold") * 100 + F.col("cost_bp")).cast("int").alias("trial"), "t", F.col("net").alias("ret"))


_TRIALS = _GRID + ", trials AS (SELECT CAST(hold * 100 + cost_bp AS INT) AS trial, t, net AS ret FROM grid)"


@query(sql("SELECT trial, count(ret) AS n, round(avg(ret) / stddev_samp(ret), 8) AS sharpe, round(avg(power(ret - m, 3)) / power(avg(power(ret - m, 2)), 1.5), 4) AS skew, round(avg(power(ret - m, 4)) / power(avg(power(ret - m, 2)), 2), 4) AS kurtosis FROM (SELECT *, avg(ret) OVER (PARTITION BY trial) AS m FROM trials) GROUP BY trial", _TRIALS))
def dsr_moments(spark, sf_dir):
    return stats.trial_moments(_trials(spark, sf_dir)).select("trial", "n", r("sharpe").alias("sharpe"), r("skew", 4).alias("skew"), r("kurtosis", 4).alias("kurtosis"))


@query(sql("SELECT trial, CAST(7 - floor((hi - t) / z.n) AS INT) AS block, count(ret) AS n, round(sum(ret), 8) + 0.0 AS s, round(sum(ret * ret), 8) AS ss FROM trials, (SELECT floor((max(t) - min(t) + 1) / 8) AS n, max(t) AS hi FROM trials) z WHERE 7 - floor((hi - t) / z.n) >= 0 GROUP BY 1, 2", _TRIALS))
def pbo_blocks(spark, sf_dir):
    return stats.pbo_blocks(_trials(spark, sf_dir), 8).select("trial", "block", "n", r("s").alias("s"), r("ss").alias("ss"))


@query(sql("SELECT trial, CAST(15 - floor((hi - t) / z.n) AS INT) AS block, count(ret) AS n, round(sum(ret), 8) + 0.0 AS s, round(sum(ret * ret), 8) AS ss FROM trials, (SELECT floor((max(t) - min(t) + 1) / 16) AS n, max(t) AS hi FROM trials) z WHERE 15 - floor((hi - t) / z.n) >= 0 GROUP BY 1, 2", _TRIALS))
def pbo_blocks_16(spark, sf_dir):
    """pbo_blocks with the blocks of pbo."""
    return stats.pbo_blocks(_trials(spark, sf_dir)).select("trial", "block", "n", r("s").alias("s"), r("ss").alias("ss"))


@query()
def pbo(spark, sf_dir):
    return spark.createDataFrame([(float(stats.pbo(_trials(spark, sf_dir))),)], "pbo double")


@query()
def deflated_sharpe(spark, sf_dir):
    d = stats.deflated_sharpe(_trials(spark, sf_dir))
    return spark.createDataFrame([(d["trial"], d["sharpe"], d["luck"], d["dsr"])], "trial int, sharpe double, luck double, dsr double")


_FOLDS = """lim AS (SELECT min(t) AS lo, max(t) AS hi FROM trials), fo AS (SELECT k AS fold, lo AS a, lo + 52 + 26 * k - 1 AS b, lo + 52 + 26 * k + 5 AS c, lo + 52 + 26 * k + 5 + 25 AS d FROM lim, (SELECT unnest(range(0, 1000)) AS k) WHERE lo + 52 + 26 * k + 5 + 26 <= hi + 1),
sc AS (SELECT fold, trial, avg(ret) / nullif(stddev_samp(ret), 0) AS score FROM trials JOIN fo ON t BETWEEN a AND b GROUP BY fold, trial),
be AS (SELECT fold, trial, score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC NULLS LAST, trial) AS k FROM sc) WHERE k = 1)"""


@query(sql("SELECT CAST(be.fold AS INT) AS fold, be.trial, round(score, 8) + 0.0 AS score, t, round(ret, 8) + 0.0 AS ret FROM be JOIN fo USING (fold) JOIN trials ON trials.trial = be.trial AND t BETWEEN c AND d", _TRIALS + ", " + _FOLDS))
def walk_forward(spark, sf_dir):
    return stats.walk_forward(_trials(spark, sf_dir), 52, 26, embargo=5).select("fold", "trial", r("score").alias("score"), "t", r("ret").alias("ret"))


_PLATEAU = """cells AS (SELECT CASE hold WHEN 1 THEN 0 WHEN 4 THEN 1 ELSE 2 END AS i, CAST(cost_bp / 10 AS INT) AS j, avg(net) / stddev_samp(net) AS value FROM grid GROUP BY hold, cost_bp), best AS (SELECT i AS bi, j AS bj, value AS best FROM cells ORDER BY value DESC, i, j LIMIT 1)"""


_NEAR = "abs(i - bi) <= 1 AND abs(j - bj) <= 1 AND (i <> bi OR j <> bj)"


@query(sql(f"""SELECT bi, bj, best, n, round(q, 8) AS neighbour_ratio, round(w, 8) AS share_within, round(g, 8) AS grid_positive, CASE WHEN q >= 0.7 THEN 'plateau' WHEN q < 0.3 THEN 'spike' WHEN q IS NOT NULL THEN 'hill' ELSE 'undetermined' END AS verdict FROM
(SELECT bi, bj, round(any_value(best), 8) AS best, count(*) FILTER ({_NEAR}) AS n, CASE WHEN any_value(best) > 0 THEN avg(value) FILTER ({_NEAR}) / any_value(best) END AS q, CASE WHEN any_value(best) > 0 THEN avg(CAST(value >= 0.5 * best AS INT)) FILTER ({_NEAR}) END AS w, avg(CAST(value > 0 AS INT)) AS g FROM cells, best GROUP BY bi, bj)""", _GRID + ", " + _PLATEAU))
def parameter_plateau(spark, sf_dir):
    g = _grid(spark, sf_dir).groupBy("hold", "cost_bp").agg((F.avg("net") / F.stddev_samp("net")).alias("value"))
    cells = g.select(F.when(F.col("hold") == 1, 0).when(F.col("hold") == 4, 1).otherwise(2).alias("i"), (F.col("cost_bp") / 10).cast("int").alias("j"), "value")
    p = stats.plateau(cells)
    return p.select("bi", "bj", "n", "verdict", *(r(c).alias(c) for c in ("best", "neighbour_ratio", "share_within", "grid_positive")))


_P = "ps AS (SELECT ticker AS name, 1.0 / (1 + count(ret1) * abs(avg(ret1))) AS p FROM panel GROUP BY ticker)"


def _ps(spark, sf_dir):
    return with_ret(panel(spark, sf_dir)).groupBy(F.col("ticker").alias("name")).agg((1 / (1 + F.count("ret1") * F.abs(F.avg("ret1")))).alias("p"))


@query(sql("SELECT name, round(least(min(p * n / k) OVER (ORDER BY p, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 8) AS q FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, name) AS k FROM ps)", _P))
def bh_fdr(spark, sf_dir):
    return stats.fdr(_ps(spark, sf_dir)).select("name", r("q").alias("q"))


@query(sql("SELECT name, round(least(max(p * (n - k + 1)) OVER (ORDER BY p, name), 1), 8) AS q FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, name) AS k FROM ps)", _P))
def holm(spark, sf_dir):
    return stats.holm(_ps(spark, sf_dir)).select("name", r("q").alias("q"))


BOOK = _BOOK = _EQUAL + f", book AS (SELECT *, hl - hs AS h FROM held), tr AS (SELECT *, coalesce(h - lag(h) OVER ({WT}), 0) AS d FROM book)"


def _book(p):
    return _held(p).withColumn("h", F.col("hl") - F.col("hs"))


@query(sql("SELECT t, round(sum(abs(d)) / 2, 8) AS turnover FROM tr GROUP BY t", _BOOK))
def turnover(spark, sf_dir):
    return costs.turnover(_book(panel(spark, sf_dir)).select("t", "ticker", "h")).select("t", r("turnover").alias("turnover"))


@query(sql("SELECT t, round(sum(abs(d) * coalesce(bp, m) / 1e4), 10) AS cost FROM (SELECT *, (high - low) / close * 100 AS bp FROM tr), (SELECT median((high - low) / close * 100) AS m FROM tr) GROUP BY t", _BOOK))
def turnover_cost(spark, sf_dir):
    h = _book(panel(spark, sf_dir)).select("t", "ticker", "h", ((F.col("high") - F.col("low")) / F.col("close") * 100).alias("bp"))
    return costs.turnover_cost(h, "bp").select("t", r("cost", 10).alias("cost"))


@query(sql("SELECT t, round(sum(greatest(d, 0) * 3.0) / 1e4 + sum(greatest(-d, 0) * 18.0) / 1e4, 10) AS cost FROM tr GROUP BY t", _BOOK))
def side_cost(spark, sf_dir):
    h = _book(panel(spark, sf_dir)).select("t", "ticker", "h", F.lit(3.0).alias("b"), F.lit(18.0).alias("s"))
    return costs.side_cost(h, "b", "s").select("t", r("cost", 10).alias("cost"))


@query(sql("SELECT t, round(sum(greatest(-h, 0) * coalesce(fee, 0)) / 1e4 / 52, 10) AS cost, count(*) FILTER (h < 0 AND fee IS NULL) AS unknown FROM (SELECT *, char_disc * 1000 AS fee FROM book) GROUP BY t", _BOOK))
def borrow_cost(spark, sf_dir):
    h = _book(panel(spark, sf_dir)).select("t", "ticker", "h", (F.col("char_disc") * 1000).alias("fee"))
    return costs.borrow_cost(h, "fee", 52).select("t", r("cost", 10).alias("cost"), "unknown")


@query(sql(f"""SELECT t, round(sum(CASE WHEN abs(d) > 0 THEN abs(d) * coalesce(CASE WHEN s IS NOT NULL AND adv IS NOT NULL THEN least(s * sqrt(abs(d) * 1e5 / nullif(adv, 0)), 0.01) END, 0.01) ELSE 0 END), 10) AS cost FROM
(SELECT *, {roll('stddev_samp(ret1)', 20, 10)} AS s, {roll('avg(close * volume)', 30)} AS adv FROM tr) GROUP BY t""", _BOOK))
def impact_cost(spark, sf_dir):
    p = panel(spark, sf_dir)
    m = costs.ImpactModel(aum=1e5)
    return m.cost(with_ret(p), _book(p).select("t", "ticker", "h")).select("t", r("cost", 10).alias("cost"))


@query(sql(f"SELECT t, round(sum(h * fwd1), 8) + 0.0 AS gross, round(sum(abs(d)) * 10 / 2e4, 10) AS cost FROM (SELECT *, coalesce(h - lag(h) OVER ({WT}), 0) AS d FROM (SELECT *, CASE WHEN close IS NULL THEN 0.0 ELSE 1.0 / count(close) OVER (PARTITION BY t) END AS h FROM f0)) GROUP BY t HAVING t < (SELECT max(t) - 1 FROM panel)", _FACTOR))
def weights_net(spark, sf_dir):
    p = panel(spark, sf_dir)
    w = p.df.where("close IS NOT NULL").select("date", "ticker", (F.lit(1.0) / F.count("*").over(Window.partitionBy("t"))).alias("w"))
    return engine.backtest_weights(p, w, spread_bp=10.0, benchmark=None, check_universe=False).daily.select("t", r("gross").alias("gross"), r("cost", 10).alias("cost"))


@query(sql("SELECT ticker, round(sum(h * fwd1), 8) + 0.0 AS contribution, round(sum(CASE WHEN h > 0 THEN h * fwd1 ELSE 0 END), 8) + 0.0 AS long, round(sum(CASE WHEN h < 0 THEN h * fwd1 ELSE 0 END), 8) + 0.0 AS short, round(sum(abs(h)), 8) AS exposure FROM book GROUP BY ticker", _BOOK))
def attribution_by_name(spark, sf_dir):
    a = event.attribution(_book(panel(spark, sf_dir)), "ticker")
    return a.select("ticker", *(r(c).alias(c) for c in a.columns[1:]))


@query(sql("SELECT tercile, round(sum(h * fwd1), 8) + 0.0 AS contribution FROM (SELECT *, CASE WHEN pr IS NULL THEN -1 ELSE least(CAST(ceil(pr * 3) AS INT) - 1, 2) END AS tercile FROM sz) GROUP BY tercile", _BOOK + ", " + rank_cte("sz", "(SELECT * EXCLUDE (v_, pr) FROM book)", "mkt_cap")))
def attribution_by_size(spark, sf_dir):
    b = _book(panel(spark, sf_dir)).withColumn("pr", C.pct_rank("mkt_cap", "eligible"))
    b = b.withColumn("tercile", F.when(F.col("pr").isNull(), -1).otherwise(F.least(F.ceil(F.col("pr") * 3).cast("int") - 1, F.lit(2))))
    return event.attribution(b, "tercile").select("tercile", r("contribution").alias("contribution"))


_BR = _EQUAL + """, bs AS (SELECT t, 'g' || substring(ticker, length(ticker)) AS grp, hl AS h, CASE WHEN eligible THEN 1.0 / nullif(count(*) FILTER (eligible) OVER (PARTITION BY t), 0) ELSE 0.0 END AS b, fwd1 FROM held),
bg0 AS (SELECT t, grp, sum(h) AS wp, sum(b) AS wb, sum(h * fwd1) AS cp, sum(b * fwd1) AS cb FROM bs GROUP BY t, grp),
bg AS (SELECT * FROM bg0 UNION ALL SELECT t, '(cash)', greatest(1 - sum(wp), 0), 0, 0, 0 FROM bg0 GROUP BY t),
bh AS (SELECT *, CASE WHEN wb > 1e-15 THEN cb / wb ELSE 0 END AS rb, CASE WHEN wp > 1e-15 THEN cp / wp ELSE 0 END AS rp, sum(cb) OVER (PARTITION BY t) AS al, sum(wb) OVER (PARTITION BY t) AS bt FROM bg)"""


@query(sql("SELECT grp, round(sum((wp - wb) * (rb - al)), 8) + 0.0 AS allocation, round(sum(wb * (rp - rb)), 8) + 0.0 AS selection, round(sum((wp - wb) * (rp - rb)), 8) + 0.0 AS interaction FROM bh WHERE bt > 0 GROUP BY grp", _BR))
def brinson(spark, sf_dir):
    h = _held(panel(spark, sf_dir))
    n = F.count(F.when(F.col("eligible"), 1)).over(Window.partitionBy("t"))
    x = h.select("t", F.concat(F.lit("g"), F.substring("ticker", -1, 1)).alias("grp"), F.col("hl").alias("h"), F.when(F.col("eligible"), F.try_divide(F.lit(1.0), n)).otherwise(0.0).alias("b"), "fwd1")
    b = event.brinson(x)
    return b.select("grp", *(r(c).alias(c) for c in b.columns[1:]))


@query(sql(f"""SELECT round(avg(lk) FILTER (ls > 1e-12), 8) AS avg_long, round(avg(ls * ls / lq) FILTER (ls > 1e-12), 6) AS effective_n_long, round(avg(lm / ls) FILTER (ls > 1e-12), 8) AS max_weight_long, round(avg(sk) FILTER (ss > 1e-12), 8) AS avg_short, round(avg(ss * ss / sq) FILTER (ss > 1e-12), 6) AS effective_n_short, round(avg(sm / ss) FILTER (ss > 1e-12), 8) AS max_weight_short,
round(avg(tu) FILTER (t > 0), 8) AS turnover, round(sum(k) / (count(*) / 52.0), 6) AS trades_per_year, round(sum(mv) / sum(k), 8) AS avg_trade, round(avg(gr), 8) AS gross, round(avg(gr) / avg(tu) FILTER (t > 0), 6) AS holding_bars FROM
(SELECT t, sum(greatest(h, 0)) AS ls, count(*) FILTER (h > 1e-12) AS lk, sum(greatest(h, 0) * greatest(h, 0)) AS lq, max(greatest(h, 0)) AS lm, sum(greatest(-h, 0)) AS ss, count(*) FILTER (-h > 1e-12) AS sk, sum(greatest(-h, 0) * greatest(-h, 0)) AS sq, max(greatest(-h, 0)) AS sm,
coalesce(sum(abs(e)), 0) / 2 AS tu, count(*) FILTER (abs(e) > 1e-9) AS k, sum(abs(e)) FILTER (abs(e) > 1e-9) AS mv, sum(abs(h)) AS gr FROM (SELECT *, h - lag(h) OVER ({WT}) AS e FROM book) GROUP BY t)""", _BOOK))
def holdings_summary(spark, sf_dir):
    s = event.holdings_summary(_book(panel(spark, sf_dir)), 52)
    return s.select(*(r(c, 6 if c.startswith(("effective", "trades", "holding")) else 8).alias(c) for c in s.columns))


@query(sql("SELECT a.*, (SELECT round(CASE WHEN sum(c) > 1e-12 THEN sum(c) FILTER (o <= 5) / sum(c) END, 8) FROM (SELECT c, row_number() OVER (ORDER BY c DESC, t) AS o FROM (SELECT t, sum(h * fwd1) AS c FROM book GROUP BY t))) AS best_share FROM (SELECT count(*) FILTER (c > 0) AS n_positive, count(*) FILTER (e > 0) AS n_held, round(sum(c) FILTER (o <= 10 AND c > 0) / sum(c) FILTER (c > 0), 8) AS top_share FROM (SELECT *, row_number() OVER (ORDER BY c DESC, ticker) AS o FROM (SELECT ticker, sum(h * fwd1) AS c, sum(abs(h)) AS e FROM book GROUP BY ticker))) a", _BOOK))
def concentration(spark, sf_dir):
    return event.concentration(_book(panel(spark, sf_dir))).select("n_positive", "n_held", r("top_share").alias("top_share"), r("best_share").alias("best_share"))


_EVENT = f"""{_FACTOR}, ev AS (SELECT *, coalesce(ret1 < -0.2, false) AND eligible AS fire, CASE WHEN count(*) OVER w = 4 THEN product(1 + coalesce(ret1, 0)) OVER w - 1 END AS cum FROM f0 WINDOW w AS ({WT} ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING))"""


def _events(p):
    return P.compounded(p, 4).withColumn("ret1", P.ret(1)).withColumn("fire", F.coalesce(F.col("ret1") < -0.2, F.lit(False)) & F.col("eligible"))


@query(sql("""SELECT count(*) AS n, round(avg(CAST(x > 0 AS INT)), 8) AS win, round(any_value(base), 8) AS base, round(avg(CAST(x > 0 AS INT)) - any_value(base), 8) + 0.0 AS lift, round(avg(x), 8) AS mean, round(quantile_cont(x, 0.5), 8) AS median, round(quantile_cont(x, 0.25), 8) AS p25, round(quantile_cont(x, 0.75), 8) AS p75, round(avg(x) FILTER (x > 0), 8) AS avg_win, round(avg(x) FILTER (x < 0), 8) AS avg_loss, round(avg(x) FILTER (x > 0) / abs(avg(x) FILTER (x < 0)), 8) AS payoff, avg(x) > 0 AND quantile_cont(x, 0.5) < 0 AS skew_warning
FROM (SELECT *, cum - 0.002::DOUBLE AS x FROM ev), (SELECT sum(k * rate) / sum(k) AS base FROM (SELECT t, count(*) AS n, avg(CAST(cum - 0.002::DOUBLE > 0 AS INT)) AS rate, count(*) FILTER (fire) AS k FROM ev WHERE eligible AND cum IS NOT NULL GROUP BY t) WHERE n >= 20) WHERE eligible AND cum IS NOT NULL AND fire""", _EVENT))
def event_trade_stats(spark, sf_dir):
    s = event.trade_stats(_events(panel(spark, sf_dir)), 20.0)
    return s.select("n", "skew_warning", *(r(c).alias(c) for c in s.columns if c not in ("n", "skew_warning")))


@query(sql("SELECT t, round(hit - pool, 8) + 0.0 AS excess FROM (SELECT t, count(*) AS n, avg(cum) AS pool, avg(cum) FILTER (fire) AS hit FROM ev WHERE eligible AND cum IS NOT NULL GROUP BY t), (SELECT floor(greatest(5.0, least(30.0, quantile_cont(n, 0.5) * 0.5))) AS lst FROM (SELECT count(*) FILTER (eligible) AS n FROM ev GROUP BY t)) WHERE n >= lst AND hit IS NOT NULL", _EVENT))
def event_daily_excess(spark, sf_dir):
    return event.daily_excess(_events(panel(spark, sf_dir))).select("t", r("excess").alias("excess"))


@query(sql("SELECT CASE WHEN count(*) >= 30 THEN round(avg(d), 8) + 0.0 END AS mean, count(*) AS n FROM (SELECT t, avg(cum) FILTER (fire) - avg(cum) FILTER (old) AS d FROM (SELECT *, eligible AND close > 0 AS old FROM ev) WHERE cum IS NOT NULL GROUP BY t HAVING count(*) FILTER (fire) >= 5 AND count(*) FILTER (old) >= 5)", _EVENT))
def paired_diff(spark, sf_dir):
    x = _events(panel(spark, sf_dir)).withColumn("old", F.col("eligible") & F.coalesce(F.col("close") > 0, F.lit(False)))
    return event.paired_diff(x, "old", "fire").select(r("mean").alias("mean"), "n")


_DUMMY = rank_cte("dn", "(SELECT *, CASE WHEN mkt_cap > 0 THEN ln(mkt_cap) END AS ls FROM ev)", "ls") + """, dq AS (SELECT t, CASE WHEN fire THEN 1.0::DOUBLE ELSE 0.0 END AS d, cum, (pr - 0.5) * sqrt(12) AS c FROM dn WHERE eligible AND cum IS NOT NULL AND pr IS NOT NULL),
de AS (SELECT t, d, cum, d - regr_intercept(d, c) OVER (PARTITION BY t) - c * regr_slope(d, c) OVER (PARTITION BY t) AS e FROM dq)"""


@query(sql("SELECT t, round(avg(cum) FILTER (d > 0) - avg(cum) FILTER (d = 0), 8) + 0.0 AS raw, round(sum(e * cum) / sum(e * e), 8) + 0.0 AS neutral FROM de GROUP BY t HAVING count(*) >= 30 AND sum(d) >= 3 AND sum(d) <= count(*) - 3", _EVENT + ", " + _DUMMY))
def dummy_neutralized(spark, sf_dir):
    p = panel(spark, sf_dir)
    x = _events(p).select("t", "ticker", "eligible", "fire", "cum").join(recipes.controls(p).select("t", "ticker", "c_logsize"), ["t", "ticker"])
    return event.dummy_neutralized(x, ["c_logsize"]).where("raw IS NOT NULL").select("t", r("raw").alias("raw"), r("neutral").alias("neutral"))


@query(sql(f"""SELECT (SELECT count(*) FROM ev WHERE fire) AS fires, (SELECT round(avg(k) FILTER (k > 0), 8) FROM (SELECT t, count(*) FILTER (fire) AS k FROM ev GROUP BY t)) AS fires_per_day, (SELECT round(avg(CAST(k > 0 AS INT)), 8) FROM (SELECT t, count(*) FILTER (fire) AS k FROM ev GROUP BY t)) AS active,
(SELECT round(avg(1 - b / a) FILTER (k > 0 AND q > 0), 8) FROM (SELECT t, count(*) FILTER (fire) AS k, count(*) FILTER (pf) AS q, count(*) FILTER (fire AND pf) AS b, count(*) FILTER (fire OR pf) AS a FROM (SELECT *, coalesce(lag(fire) OVER ({WT}), false) AS pf FROM ev) GROUP BY t)) AS daily_turnover,
(SELECT count(*) FROM fn) AS names, (SELECT round(sum(k) FILTER (o <= 10) / sum(k), 8) FROM fn) AS top10, (SELECT round(max(k) / (SELECT count(DISTINCT t) FROM ev), 8) FROM fn) AS max_name_share,
(SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT ticker, t - row_number() OVER ({WT}) AS g FROM ev WHERE fire AND ticker IN (SELECT ticker FROM fn WHERE o <= 30)) GROUP BY ticker, g)) AS max_consecutive""", _EVENT + ", fn AS (SELECT ticker, k, row_number() OVER (ORDER BY k DESC, ticker) AS o FROM (SELECT ticker, count(*) AS k FROM ev WHERE fire GROUP BY ticker))"))
def fire_structure(spark, sf_dir):
    s = event.fire_structure(_events(panel(spark, sf_dir)))
    return s.select("fires", "names", "max_consecutive", *(r(c).alias(c) for c in ("fires_per_day", "active", "daily_turnover", "top10", "max_name_share")))


@query(sql(f"SELECT t, ticker, round(sum(w) OVER ({WT} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 8) AS h FROM (SELECT *, coalesce(CASE WHEN fire THEN 1.0 ELSE 0.0 END / nullif(sum(CASE WHEN fire THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY t), 0) / 4, 0)::DOUBLE AS w FROM ev)", _EVENT))
def event_weights(spark, sf_dir):
    x = _events(panel(spark, sf_dir)).withColumn("w", F.coalesce(portfolio.event_weights("fire", 4), F.lit(0.0)))
    return x.select("t", "ticker", r(F.sum("w").over(C.back(4))).alias("h"))


@query(sql("SELECT year(date) AS year, round(avg(net), 8) + 0.0 AS mean, count(*) AS n FROM net GROUP BY 1 HAVING count(*) >= 40", _DAILY))
def yearly_gate(spark, sf_dir):
    return event.yearly(_net(spark, sf_dir), "net").select(F.col("year").cast("long").alias("year"), r("mean").alias("mean"), "n")


@query(sql("SELECT CASE WHEN date <= (SELECT max(date) - INTERVAL 12 MONTH FROM net) THEN 'in' ELSE 'out' END AS part, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(avg(net), 8) + 0.0 END AS mean FROM net GROUP BY 1", _DAILY))
def oos_holdout(spark, sf_dir):
    return event.holdout(_net(spark, sf_dir), "net").select("part", "n", r("mean").alias("mean"))


@query(sql("""SELECT half, round(avg(net), 8) + 0.0 AS mean FROM (SELECT net, CASE WHEN row_number() OVER (ORDER BY t) <= floor(count(*) OVER () / 2) THEN 1 ELSE 2 END AS half FROM net) GROUP BY half""", _DAILY))
def subperiod(spark, sf_dir):
    return event.subperiod(_net(spark, sf_dir), "net", 4).select("half", r("mean").alias("mean"))


@query(sql("SELECT t, ticker, coalesce(round_even(hl * 1e6 / (close * 10), 0) * 10 * close / 1e6, 0) AS w FROM held", _EQUAL))
def round_to_lots(spark, sf_dir):
    h = _held(panel(spark, sf_dir))
    return h.select("t", "ticker", execution.round_to_lots("hl", "close", 1e6, 10.0).alias("w"))


@query("WITH RECURSIVE" + sql(f"""SELECT t, ticker, round(h, 8) + 0.0 AS h FROM st""", _BOOK + ", " + HALTED + ", " + TRADABLE + """, tg AS MATERIALIZED (SELECT book.t, book.ticker, book.h AS w, tb.can_buy, tb.can_sell FROM book JOIN tb ON book.t = tb.t AND book.ticker = tb.ticker),
st AS (SELECT t, ticker, CASE WHEN w > 0 AND NOT can_buy OR w < 0 AND NOT can_sell THEN 0.0 ELSE w END AS h FROM tg WHERE t = 0
UNION ALL SELECT tg.t, tg.ticker, CASE WHEN w > st.h AND NOT can_buy OR w < st.h AND NOT can_sell THEN st.h ELSE w END FROM st JOIN tg ON tg.ticker = st.ticker AND tg.t = st.t + 1)""")[4:])
def realized_fills(spark, sf_dir):
    p = panel(spark, sf_dir)
    mask = execution.tradability(halted_panel(p).df, limit=0.3, max_gap=3).select("t", "ticker", "can_buy", "can_sell")
    x = execution.realize(_book(p).select("t", "ticker", F.col("h").alias("w")).join(mask, ["t", "ticker"]))
    return x.select("t", "ticker", r("h").alias("h"))


@query(sql("SELECT t, ticker, round(0.6 * hl - 0.4 * hs, 8) + 0.0 AS h FROM held", _EQUAL))
def blend(spark, sf_dir):
    h = _held(panel(spark, sf_dir))
    return portfolio.blend([(h.select("t", "ticker", F.col("hl").alias("h")), 0.6), (h.select("t", "ticker", F.col("hs").alias("h")), -0.4)]).select("t", "ticker", r("h").alias("h"))


@query(sql("SELECT a.trial AS a, b.trial AS b, round(corr(a.ret, b.ret), 8) AS corr FROM trials a JOIN trials b ON a.t = b.t AND a.trial < b.trial GROUP BY 1, 2", _TRIALS))
def strategy_correlation(spark, sf_dir):
    x = _trials(spark, sf_dir)
    y = x.select(F.col("trial").alias("b"), "t", F.col("ret").alias("rb"))
    return x.select(F.col("trial").alias("a"), "t", "ret").join(y, "t").where("a < b").groupBy("a", "b").agg(r(F.corr("ret", "rb")).alias("corr"))


@query(sql("SELECT trial, round(sum((hl - hs) * f), 8) + 0.0 AS total FROM (SELECT held.t, held.ticker, hl, hs, x.s AS trial, p2.fwd1 AS f FROM held, (SELECT unnest([21, 50]) AS s) x JOIN f0 p2 ON p2.ticker = held.ticker AND p2.t = (held.t + x.s) % (SELECT max(t) + 1 FROM panel)) GROUP BY trial", _EQUAL))
def shift_permutation(spark, sf_dir):
    p = panel(spark, sf_dir)
    h = _held(p)
    n = h.agg((F.max("t") + 1).alias("n"))
    s = h.select("t", "ticker", "hl", "hs").crossJoin(F.broadcast(n)).select("ticker", "hl", "hs", "t", "n", F.explode(F.array(F.lit(21), F.lit(50))).alias("trial"))
    s = s.withColumn("u", F.pmod(F.col("t") + F.col("trial"), F.col("n")).cast("int"))
    f = h.select("ticker", F.col("t").alias("u"), F.col("fwd1").alias("f"))
    return s.join(f, ["ticker", "u"]).groupBy("trial").agg(r(F.sum((F.col("hl") - F.col("hs")) * F.col("f"))).alias("total"))


@query()
def sharpe_bootstrap(spark, sf_dir):
    b = stats.stationary_bootstrap(_net(spark, sf_dir), stats.sharpe_of, 400)
    return b.agg(F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.5).alias("mid"), F.percentile("value", 0.975).alias("hi"))


@query()
def sharpe_interval(spark, sf_dir):
    d = stats.sharpe_ci(_net(spark, sf_dir), 52, 200)
    return spark.createDataFrame([(d["sharpe"], d["lo"], d["hi"])], "sharpe double, lo double, hi double")


@query()
def sharpe_difference(spark, sf_dir):
    x = _grid(spark, sf_dir).where("cost_bp = 10.0")
    d = stats.sharpe_diff_ci(x.where("hold = 1").select("t", "net"), x.where("hold = 4").select("t", "net"), 52, 200)
    return spark.createDataFrame([(d["diff"], d["lo"], d["hi"], d["p"])], "diff double, lo double, hi double, p double")


@query()
def drawdown_distribution(spark, sf_dir):
    d = stats.drawdown_distribution(_net(spark, sf_dir), 200)
    return spark.createDataFrame([(d["realized"], d["p05"], d["p50"], d["p95"], d["p_worse"])], "realized double, p05 double, p50 double, p95 double, p_worse double")


# --- the engine with every cost ---------------------------------------------

_ENGINE = f"""{HALTED}, e0 AS (SELECT *, -(close / nullif(lag(close, 5) OVER ({WT}), 0) - 1) AS factor, coalesce(lag(delist_after) OVER ({WT}), false) AS nx FROM hh),
e1 AS (SELECT *, CASE WHEN nx THEN -0.3::DOUBLE ELSE coalesce(ret1, 0) END AS rr FROM e0),
e2 AS (SELECT *, coalesce(lead(rr, 2) OVER ({WT}), 0) AS fwd1, coalesce(lead(funding, 2) OVER ({WT}), 0) AS fund1, eligible AND lead(shortable, 1, true) OVER ({WT}) AS se, coalesce(lead(run = 2, 1) OVER ({WT}), false) AS frozen, coalesce(lead(coalesce(char_disc * 1000, 50)) OVER ({WT}), coalesce(char_disc * 1000, 50)) AS fee,
  {roll('stddev_samp(ret1)', 20, 10)} AS sd, {roll('avg(close * volume)', 30)} AS adv FROM e1),
{rank_cte('rl', 'e2', 'factor')}, {rank_cte('rs', '(SELECT * EXCLUDE (v_, pr), pr AS prl FROM rl)', 'factor', 'se')},
ew AS (SELECT *, coalesce(CASE WHEN prl >= 1 - 0.2::DOUBLE THEN 1.0 ELSE 0.0 END / nullif(sum(CASE WHEN prl >= 1 - 0.2::DOUBLE THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY t), 0), 0) AS wl, coalesce(CASE WHEN pr <= 0.2::DOUBLE THEN 1.0 ELSE 0.0 END / nullif(sum(CASE WHEN pr <= 0.2::DOUBLE THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY t), 0), 0) AS ws FROM rs),
eh AS (SELECT *, sum(wl) OVER w / least(4, t + 1) AS hl, -sum(ws) OVER w / least(4, t + 1) AS hs FROM ew WINDOW w AS ({WT} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
buy AS (SELECT t, CASE WHEN coalesce(lead(date) OVER (ORDER BY t), date) >= DATE '1998-01-05' THEN 5.0::DOUBLE ELSE 3.0 END AS b FROM cal),
em AS (SELECT *, coalesce(hl - lag(hl) OVER ({WT}), 0) AS dl, coalesce(hs - lag(hs) OVER ({WT}), 0) AS ds FROM eh JOIN buy USING (t)),
ed AS (SELECT t, sum((hl + hs) * fwd1) AS gross, sum(abs(dl) + abs(ds)) * 10 / 2e4 AS spread, sum((greatest(dl, 0) + greatest(ds, 0)) * b / 1e4 + (greatest(-dl, 0) + greatest(-ds, 0)) * 18 / 1e4) AS side, sum((greatest(-hl, 0) + greatest(-hs, 0)) * fee / 1e4 / 52) AS borrow, sum((hl + hs) * fund1) AS funding,
  sum(CASE WHEN frozen THEN greatest(hl, 0) * -0.1 ELSE 0 END) AS mark, sum(CASE WHEN abs(dl + ds) > 0 THEN abs(dl + ds) * coalesce(CASE WHEN sd IS NOT NULL AND adv IS NOT NULL THEN least(sd * sqrt(abs(dl + ds) * 1e5 / nullif(adv, 0)), 0.01) END, 0.01) ELSE 0 END) AS impact,
  coalesce(sum(CASE WHEN eligible AND mkt_cap > 0 THEN mkt_cap * fwd1 ELSE 0 END) / nullif(sum(CASE WHEN eligible AND mkt_cap > 0 THEN mkt_cap ELSE 0 END), 0), 0) AS bench FROM em GROUP BY t HAVING t < (SELECT max(t) - 1 FROM panel))"""


def _full(spark, sf_dir, benchmark="cap"):
    p = halted_panel(panel(spark, sf_dir))
    buy = spark.sql("SELECT * FROM VALUES (DATE '1990-01-01', 3.0D), (DATE '1998-01-05', 5.0D) AS x(effective_date, value)")
    fee = p.df.select("date", "ticker", F.coalesce(F.col("char_disc") * 1000, F.lit(50.0)).alias("value"))
    return engine.backtest_portfolio(
        p, recipes.reversal(5), long_q=0.2, short_q=0.2, hold=HOLD, spread_bp=10.0, buy_bp=buy, sell_bp=18.0, borrow_bp=fee, benchmark=benchmark, grid=False, delist_return=-0.3, freeze_days=2, freeze_return=-0.1, impact=costs.ImpactModel(aum=1e5),
    )


@query(sql("SELECT t, round(gross, 8) + 0.0 AS gross, round(spread, 11) AS spread, round(side, 11) AS side, round(borrow, 11) AS borrow, round(funding, 11) + 0.0 AS funding, round(mark, 8) + 0.0 AS mark, round(impact, 11) AS impact, round(bench, 8) + 0.0 AS bench, round(CASE WHEN t > coalesce(rt, t) THEN 0 WHEN t = rt THEN -1 ELSE n END, 8) + 0.0 AS net FROM (SELECT *, min(CASE WHEN n <= -1 THEN t END) OVER () AS rt FROM (SELECT *, gross + mark - spread - side - borrow - funding - impact AS n FROM ed))", _ENGINE))
def engine_costs(spark, sf_dir):
    """The portfolio engine with dated buying rates, a selling rate, a borrow panel, funding, a delisting return, suspensions, impact, names that cannot be shorted and a benchmark by size."""
    d = _full(spark, sf_dir).daily
    return d.select("t", *(r(c).alias(c) for c in ("gross", "mark", "bench", "net")), *(r(c, 11).alias(c) for c in ("spread", "side", "borrow", "funding", "impact")))


@query(sql(f"""SELECT t, round(sum(h * fwd1), 8) + 0.0 AS gross, round(sum(abs(d)) * 8 / 2e4, 11) AS spread, round(sum(greatest(d, 0) * 2 / 1e4 + greatest(-d, 0) * 20 / 1e4), 11) AS side, round(sum(greatest(-h, 0) * 100 / 1e4 / 52), 11) AS borrow, round(sum(abs(d)) / 2, 8) AS turnover FROM
(SELECT *, coalesce(h - lag(h) OVER ({WT}), 0) AS d FROM (SELECT t, ticker, fwd1, CASE WHEN eligible THEN (k % 5 - 2) / 100.0::DOUBLE ELSE 0.0 END AS h FROM (SELECT *, coalesce(lead(ret1, 2) OVER ({WT}), 0) AS fwd1, CAST(substring(ticker, 2) AS INT) AS k FROM panel))) GROUP BY t HAVING t < (SELECT max(t) - 1 FROM panel)"""))
def engine_weights(spark, sf_dir):
    """Given weights, long and short, with costs on the net trade."""
    p = panel(spark, sf_dir)
    w = p.df.where("eligible").select("date", "ticker", ((F.expr("CAST(substring(ticker, 2) AS INT)") % 5 - 2) / 100).alias("w"))
    d = engine.backtest_weights(p, w, spread_bp=8.0, buy_bp=2.0, sell_bp=20.0, borrow_bp=100.0).daily
    return d.select("t", r("gross").alias("gross"), *(r(c, 11).alias(c) for c in ("spread", "side", "borrow")), r("turnover").alias("turnover"))
