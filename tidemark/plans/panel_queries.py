"""Queries on the panel: construction, windows, ranks, recipes, joins, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import columns as C
from ..operators import costs, engine, event, execution, joins, recipes, sweeps
from ..operators import panel as P
from ..sources import bars as B
from ..sources import long_table
from ..streaming.bars import sessions
from .base import PANEL, WT, bars, panel, query, r, rank_cte, roll, sql, table, with_ret


def halted_panel(p: P.Panel) -> P.Panel:
    """The panel with bars without volume, ends of every fifth security, days without short sales and a funding rate, all by rule."""
    k = F.expr("CAST(substring(ticker, 2) AS INT)")
    dead = k % 5 == 0
    df = p.df.withColumn("close", F.when(~(dead & (F.col("t") > 250 + k % 40)), F.col("close"))).withColumn("volume", F.when((F.col("t") + k * 7) % 29 < 4, 0.0).otherwise(F.col("volume")))
    return p.with_df(df.withColumn("delist_after", dead & (F.col("t") == 250 + k % 40)).withColumn("shortable", (F.col("t") + k) % 11 != 0).withColumn("funding", ((F.col("t") + k) % 7 - 3) / 1e4))


HALTED = f"""hp0 AS (SELECT *, CAST(substring(ticker, 2) AS INT) AS k FROM panel),
hp AS (SELECT t, date, ticker, k, CASE WHEN NOT (k % 5 = 0 AND t > 250 + k % 40) THEN close END AS close, CASE WHEN (t + k * 7) % 29 < 4 THEN 0.0 ELSE volume END AS volume, high, low, mkt_cap, char_disc, eligible, k % 5 = 0 AND t = 250 + k % 40 AS delist_after, (t + k) % 11 <> 0 AS shortable, ((t + k) % 7 - 3) / 1e4::DOUBLE AS funding FROM hp0),
hr AS (SELECT *, close / nullif(lag(close) OVER ({WT}), 0) - 1 AS ret1, close IS NOT NULL AND NOT coalesce(volume > 0, false) AS halted, coalesce(max(CASE WHEN delist_after THEN 1 ELSE 0 END) OVER ({WT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS gone,
  CASE WHEN close IS NULL THEN t - coalesce(max(CASE WHEN close IS NOT NULL THEN t END) OVER ({WT}), -1) ELSE 0 END AS gap FROM hp),
hg AS (SELECT *, sum(CASE WHEN halted THEN 0 ELSE 1 END) OVER ({WT}) AS isl FROM hr),
hh AS (SELECT *, CASE WHEN halted THEN count(*) FILTER (halted) OVER (PARTITION BY ticker, isl ORDER BY t) ELSE 0 END AS run FROM hg)"""


def _column(name: str, spark_column, sql_column: str, more: str = "", source: str = "panel", prepare=with_ret, decimals: int | None = 8):
    """A query of t, ticker and one column; rounded where sums decide its last bits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return prepare(panel(spark, sf_dir)).select("t", "ticker", (spark_column() if decimals is None else r(spark_column(), decimals)).alias("value"))

    query(sql(f"SELECT t, ticker, {sql_column if decimals is None else f'round({sql_column}, {decimals}) + 0.0'} AS value FROM {source}", more), name)(run)


_column("ret1", lambda: F.col("ret1"), "ret1", decimals=None)
_column("ret5", lambda: P.ret(5), f"close / nullif(lag(close, 5) OVER ({WT}), 0) - 1", decimals=None)
_column("rolling_mean_adv", lambda: C.rolling(F.avg, F.col("close") * F.col("volume"), 20), roll("avg(close * volume)", 20), decimals=6)
_column("rolling_std", lambda: C.rolling(F.stddev_samp, "ret1", 21, 10), roll("stddev_samp(ret1)", 21, 10))
_column("rolling_max", lambda: C.rolling(F.max, "close", 52, 26), roll("max(close)", 52, 26), decimals=None)
_column("rolling_median", lambda: C.rolling_median("close", 12, 8), roll("median(close)", 12, 8), decimals=None)
_column("age_cumcount", lambda: F.count("close").over(C.by_time()).cast("double"), f"CAST(count(close) OVER ({WT}) AS DOUBLE)", decimals=None)
_column("ffill", lambda: C.ffill("close"), f"last_value(close IGNORE NULLS) OVER ({WT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", decimals=None)
_column("pct_rank", lambda: C.pct_rank("close", "eligible"), "pr", rank_cte("rk", "panel", "close"), "rk", decimals=None)
_column("xs_norm", lambda: C.xs_norm("close", "eligible"), "(pr - 0.5) * sqrt(12)", rank_cte("rk", "panel", "close"), "rk")
_column("recipe_momentum", lambda: recipes.momentum(26, 4), f"lag(close, 4) OVER ({WT}) / nullif(lag(close, 26) OVER ({WT}), 0) - 1", decimals=None)
_column("recipe_reversal", lambda: recipes.reversal(5), f"-(close / nullif(lag(close, 5) OVER ({WT}), 0) - 1)", decimals=None)
_column("recipe_low_volatility", lambda: recipes.low_volatility(30), "-(" + roll("stddev_samp(ret1)", 30, 20) + ")")
_column("recipe_size", lambda: recipes.size(), "CASE WHEN mkt_cap > 0 THEN -mkt_cap END", decimals=None)
_column("recipe_illiquidity", lambda: recipes.illiquidity(10), "-(" + roll("avg(close * volume)", 10) + ")", decimals=6)
_column("recipe_volume_shock", lambda: recipes.volume_shock(3, 12), f"({roll('avg(volume)', 3)}) / nullif(({roll('avg(volume)', 12)}), 0) - 1")
_column("recipe_distance_to_high", lambda: recipes.distance_to_high(12), f"close / nullif(({roll('max(close)', 12)}), 0) - 1", decimals=None)
_column(
    "forward_h", lambda: F.col("fwd"), f"CAST(CAST(lead(close, 5) OVER ({WT}) / nullif(lead(close, 1) OVER ({WT}), 0) - 1 AS FLOAT) AS DOUBLE)", prepare=lambda p: P.forward(p, 4), decimals=None
)
_column(
    "forward_compounded", lambda: F.col("cum"), f"CASE WHEN count(*) OVER w = 4 THEN product(1 + coalesce(ret1, 0)) OVER w - 1 END", source=f"panel WINDOW w AS ({WT} ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING)", prepare=lambda p: P.compounded(p, 4)
)
_column("corwin_schultz", lambda: costs.corwin_schultz(), "CASE WHEN al IS NOT NULL THEN least(greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0.0), 0.2) END", f"""
cs0 AS (SELECT *, lag(high) OVER ({WT}) AS h0, lag(low) OVER ({WT}) AS l0 FROM panel),
cs AS (SELECT *, (sqrt(2 * (ln(high / low) * ln(high / low) + ln(h0 / l0) * ln(h0 / l0))) - sqrt(ln(high / low) * ln(high / low) + ln(h0 / l0) * ln(h0 / l0))) / (3 - 2 * sqrt(2::DOUBLE))
  - sqrt(ln(greatest(h0, high) / least(l0, low)) * ln(greatest(h0, high) / least(l0, low)) / (3 - 2 * sqrt(2::DOUBLE))) AS al FROM cs0 WHERE h0 IS NOT NULL AND high IS NOT NULL
  UNION ALL SELECT *, NULL FROM cs0 WHERE h0 IS NULL OR high IS NULL)""", "cs")  # fmt: skip
_column(
    "rolling_beta", lambda: F.when(F.count(F.col("ret1") * F.col("m")).over(C.back(30)) >= 20, C.div(F.covar_samp("ret1", "m").over(C.back(30)), F.var_samp("m").over(C.back(30)))),
    f"CASE WHEN count(ret1 * m) OVER w >= 20 THEN covar_samp(ret1, m) OVER w / nullif(var_samp(m) OVER w, 0) END",
    "mk AS (SELECT t, median(ret1) AS m FROM panel GROUP BY t), pm AS (SELECT * FROM panel JOIN mk USING (t))", f"pm WINDOW w AS ({WT} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)",
    prepare=lambda p: (x := with_ret(p)).join(x.groupBy("t").agg(F.percentile("ret1", 0.5).alias("m")), "t"),
)


@query(sql("SELECT t, ticker, close IS NOT NULL AND coalesce(a >= 20000, false) AS eligible FROM (SELECT *, " + roll("avg(close * volume)", 20) + " AS a FROM panel)"))
def pit_eligible(spark, sf_dir):
    return panel(spark, sf_dir).df.select("t", "ticker", P.pit_eligible(min_value=20000.0).alias("eligible"))


@query(sql("SELECT t, ticker, rk AS rank FROM (SELECT t, ticker, row_number() OVER (PARTITION BY t ORDER BY v DESC, ticker) AS rk FROM (SELECT *, close * volume AS v FROM panel) WHERE v IS NOT NULL) WHERE rk <= 10"))
def topn_universe(spark, sf_dir):
    df = panel(spark, sf_dir).df.withColumn("v", F.col("close") * F.col("volume")).where("v IS NOT NULL")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("v"), "ticker")).cast("long")).where("rank <= 10").select("t", "ticker", "rank")


@query(sql("SELECT ticker, max(t) AS last_t, max(t) < (SELECT max(t) - 4 FROM panel) AS ended FROM panel WHERE close IS NOT NULL GROUP BY ticker"))
def last_bar_delist(spark, sf_dir):
    df = panel(spark, sf_dir).df
    end = df.agg(F.max("t").alias("e"))
    return df.where("close IS NOT NULL").groupBy("ticker").agg(F.max("t").alias("last_t")).crossJoin(F.broadcast(end)).select("ticker", "last_t", (F.col("last_t") < F.col("e") - 4).alias("ended"))


@query(sql("SELECT t, ticker, run FROM hh", HALTED))
def halt_runs(spark, sf_dir):
    return execution.halt_runs(halted_panel(panel(spark, sf_dir)).df).select("t", "ticker", F.col("halt_run").cast("long").alias("run"))


@query(sql(f"SELECT t, ticker, coalesce(lead(run = 2, 1) OVER ({WT}), false) AS frozen FROM hh", HALTED))
def freeze_hits(spark, sf_dir):
    return execution.freeze_hits(halted_panel(panel(spark, sf_dir)).df, 2, 1).select("t", "ticker", "frozen")


_EPISODES = f"""ep0 AS (SELECT *, last_value(CASE WHEN NOT halted THEN close END IGNORE NULLS) OVER ({WT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(CASE WHEN close IS NOT NULL THEN t END IGNORE NULLS) OVER ({WT} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt, first_value(close IGNORE NULLS) OVER ({WT} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nc FROM hh),
ends AS (SELECT ticker, max(t) FILTER (close IS NOT NULL) AS lt, arg_max(close, t) FILTER (close IS NOT NULL) AS lc, bool_or(delist_after) AS flagged FROM hp GROUP BY ticker),
ep1 AS (SELECT ticker, min(t) AS start_t, max(t) AS end_t, count(*) AS days, arg_min(coalesce(before, -1), t) AS b, arg_max(coalesce(nt, -1), t) AS nt, arg_max(coalesce(nc, -1), t) AS nc FROM ep0 WHERE halted GROUP BY ticker, isl HAVING count(*) >= 3),
ep AS (SELECT *, CASE WHEN flagged AND lt = end_t THEN 'ended_in_halt' WHEN end_t = (SELECT max(t) FROM hp) OR nt < 0 THEN 'ongoing' WHEN flagged AND lt - nt <= 20 THEN 'resumed_then_delisted' ELSE 'resumed' END AS outcome FROM ep1 JOIN ends USING (ticker))"""


@query(sql("SELECT ticker, start_t, end_t, days, outcome, round(CASE WHEN b < 0 OR outcome = 'ongoing' THEN NULL WHEN outcome = 'ended_in_halt' THEN 0.0 WHEN outcome = 'resumed' THEN nc / b - 1 ELSE lc / b - 1 END, 8) + 0.0 AS ret FROM ep", HALTED + ", " + _EPISODES))
def freeze_episodes(spark, sf_dir):
    e = execution.freeze_episodes(halted_panel(panel(spark, sf_dir)).df, 3, 20)
    return e.select("ticker", "start_t", "end_t", "days", "outcome", r("ret").alias("ret"))


TRADABLE = "tb AS (SELECT *, (close IS NOT NULL AND NOT halted OR gone OR gap > 3) AND NOT coalesce(ret1 >= 0.3::DOUBLE - 0.01::DOUBLE, false) AS can_buy, (close IS NOT NULL AND NOT halted OR gone OR gap > 3) AND NOT coalesce(ret1 <= -(0.3::DOUBLE - 0.01::DOUBLE), false) AS can_sell FROM hh)"


@query(sql("SELECT t, ticker, can_buy, can_sell FROM tb", HALTED + ", " + TRADABLE))
def tradability(spark, sf_dir):
    return execution.tradability(halted_panel(panel(spark, sf_dir)).df, limit=0.3, max_gap=3).select("t", "ticker", "can_buy", "can_sell")


@query(sql(
    "SELECT count(*) AS n, min(t) AS first_t, (SELECT ticker FROM mz ORDER BY t, ticker LIMIT 1) AS first_ticker FROM mz", HALTED + f", mz AS (SELECT * FROM (SELECT t, ticker, k, eligible AND k % 3 = 0 AS held, lead(close, 1) OVER ({WT}) IS NULL OR lead(close, 2) OVER ({WT}) IS NULL AS miss, max(CASE WHEN delist_after THEN 1 ELSE 0 END) OVER ({WT} ROWS BETWEEN UNBOUNDED PRECEDING AND 2 FOLLOWING) > 0 AS fl FROM hp) WHERE miss AND held AND NOT fl AND t < (SELECT max(t) - 1 FROM hp))"))
def held_without_price(spark, sf_dir):
    h = execution.held_without_price(halted_panel(panel(spark, sf_dir)).df, F.col("eligible") & (F.expr("CAST(substring(ticker, 2) AS INT)") % 3 == 0), 1)
    return h.select("n", "first_t", "first_ticker")


_AUDIT = """mk AS (SELECT t, avg(ret1) AS m FROM panel WHERE eligible GROUP BY t), me AS (SELECT t, m, product(1 + m) OVER (ORDER BY t) AS e FROM mk WHERE m IS NOT NULL), ls AS (SELECT ticker, max(t) AS l, max(date) AS d FROM panel WHERE close IS NOT NULL GROUP BY ticker),
vo AS (SELECT stddev_samp(ret1) * sqrt(52) AS v FROM panel WHERE eligible GROUP BY ticker HAVING stddev_samp(ret1) > 0), cv AS (SELECT t, count(close) AS k FROM panel GROUP BY t), mt AS (SELECT max(t) AS e, max(date) AS d FROM panel)"""


@query(sql("""SELECT count(DISTINCT t) AS n_dates, count(DISTINCT ticker) AS n_tickers, count(close) AS n_prices, count(*) FILTER (eligible) AS n_eligible, round(avg(CAST(abs(ret1) > 0.5 AS INT)), 8) AS extreme_share, round(quantile_cont(ret1, 0.05), 8) AS p05, round(quantile_cont(ret1, 0.95), 8) AS p95, round(avg(CASE WHEN eligible THEN CAST(abs(ret1) > 0.3 AS INT) END), 8) AS extreme_eligible,
(SELECT round(avg(CAST(l < e AS INT)), 8) FROM ls, mt) AS ended_share, (SELECT round(avg(CAST(date_diff('day', ls.d, mt.d) > 30 AS INT)), 8) FROM ls, mt) AS ended_before_end_share, (SELECT round(min(m), 8) FROM mk) AS worst_market, (SELECT round(min(f), 7) FROM (SELECT e / max(e) OVER (ORDER BY t) - 1 AS f FROM me)) AS market_max_drawdown,
(SELECT round(power(product(1 + m), 52.0 / count(m)) - 1, 6) FROM me) AS market_annual_return, (SELECT round(quantile_cont(v, 0.05), 8) FROM vo) AS volatility_p05, (SELECT round(quantile_cont(v, 0.95), 8) FROM vo) AS volatility_p95, (SELECT round(avg(k) FILTER (t > e - 20) / quantile_cont(k, 0.5) FILTER (t <= e - 20), 8) FROM cv, mt) AS tail_coverage FROM panel""", _AUDIT))
def audit(spark, sf_dir):
    a = P.audit(panel(spark, sf_dir))
    n = {"market_max_drawdown": 7, "market_annual_return": 6}
    return a.select("n_dates", "n_tickers", "n_prices", "n_eligible", *(r(c, n.get(c, 8)).alias(c) for c in ("extreme_share", "p05", "p95", "extreme_eligible", "ended_share", "ended_before_end_share", "worst_market", "market_max_drawdown", "market_annual_return", "volatility_p05", "volatility_p95", "tail_coverage")))


@query(sql("SELECT year, round(names, 8) AS names, round(names / first(names) OVER (ORDER BY year), 8) AS growth FROM (SELECT year(date) AS year, avg(k) AS names FROM (SELECT t, date, count(*) FILTER (eligible) AS k FROM panel GROUP BY t, date) GROUP BY 1)"))
def eligible_by_year(spark, sf_dir):
    return P.eligible_by_year(panel(spark, sf_dir)).select(F.col("year").cast("long").alias("year"), r("names").alias("names"), r("growth").alias("growth"))


@query(sql(f"SELECT t, bench FROM (SELECT t, lead(b, 2) OVER (ORDER BY t) AS bench FROM (SELECT cal.t, avg(close) AS b FROM cal LEFT JOIN bars ON bars.date = cal.date AND bars.ticker = 'S1' GROUP BY cal.t))"))
def align_benchmark(spark, sf_dir):
    p = panel(spark, sf_dir)
    return engine.align_benchmark(p, p.df.where("ticker = 'S1' AND close IS NOT NULL").select("date", F.col("close").alias("ret")))


@query(sql("SELECT round(avg(s), 8) AS spread FROM (SELECT avg(fwd) FILTER (pr >= 0.9) - avg(fwd) FILTER (pr <= 0.1) AS s FROM sp WHERE fwd IS NOT NULL GROUP BY t HAVING count(*) FILTER (pr >= 0.9) >= 3 AND count(*) FILTER (pr <= 0.1) >= 3)", rank_cte("sp", f"(SELECT *, CAST(CAST(lead(close, 5) OVER ({WT}) / nullif(lead(close, 1) OVER ({WT}), 0) - 1 AS FLOAT) AS DOUBLE) AS fwd FROM panel)", "close")))
def decile_spread(spark, sf_dir):
    return sweeps.decile_spread(P.forward(panel(spark, sf_dir), 4), "close").select(r("spread").alias("spread"))


@query(sql(f"SELECT t, ticker, coalesce(lead(shortable, 1) OVER ({WT}), true) AS can_sell FROM hp", HALTED))
def exec_masks(spark, sf_dir):
    """A mask as read on the execution day."""
    df = halted_panel(panel(spark, sf_dir)).df.withColumn("can_buy", F.lit(True)).withColumn("can_sell", F.col("shortable"))
    return df.select("t", "ticker", execution.exec_masks(1)["can_sell"].alias("can_sell"))


@query(sql(f"SELECT t, ticker, CASE WHEN low > 0 THEN low END AS close FROM panel"))
def at_prices(spark, sf_dir):
    return execution.at_prices(panel(spark, sf_dir).df, "low").select("t", "ticker", "close")


@query(sql("SELECT ticker, round(exp(2 - 0.4 * ln(v)), 8) AS q, round(least(greatest(coalesce(CASE WHEN CAST(substring(ticker, 2) AS INT) % 2 = 0 THEN 7.5 END, exp(2 - 0.4 * ln(v))), 0.05), 6.0), 8) AS bp FROM (SELECT ticker, avg(close * volume) AS v FROM panel GROUP BY ticker)"))
def spread_panel(spark, sf_dir):
    df = panel(spark, sf_dir).df.groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("v"))
    df = df.withColumn("m", F.when(F.expr("CAST(substring(ticker, 2) AS INT)") % 2 == 0, 7.5))
    return df.select("ticker", r(costs.spread_bp("v", 2.0, -0.4, lo=0.0, hi=1e9)).alias("q"), r(costs.spread_bp("v", 2.0, -0.4, "m", 0.05, 6.0)).alias("bp"))


@query(sql("SELECT t, ticker, close FROM panel WHERE ticker IN (SELECT ticker FROM panel WHERE close IS NOT NULL GROUP BY ticker HAVING date_diff('day', max(date), (SELECT max(date) FROM panel)) <= 5)"))
def survivors_only(spark, sf_dir):
    return P.survivors_only(panel(spark, sf_dir)).df.select("t", "ticker", "close")


@query("WITH b AS (SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS close FROM lineitem) SELECT (SELECT count(*) FROM b) AS rows, (SELECT count(*) FROM b WHERE id IS NULL OR date IS NULL) AS null_keys, (SELECT count(*) FROM b WHERE close <= 0) AS bad_prices, (SELECT count(*) FROM (SELECT id, date FROM b GROUP BY 1, 2 HAVING count(*) > 1)) AS repeated")
def long_table_checks(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("close"))
    return long_table.checks(b)


@query(sql("SELECT t, ticker, close FROM panel WHERE date <= DATE '1998-01-01'"))
def truncate(spark, sf_dir):
    import datetime

    return panel(spark, sf_dir).truncate(datetime.date(1998, 1, 1)).df.select("t", "ticker", "close")


@query("""WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), rates AS (SELECT DATE '1900-01-01' AS d, 10.0::DOUBLE AS value UNION ALL SELECT DATE '1996-06-15', 15.0 UNION ALL SELECT DATE '1998-03-02', 20.0)
SELECT date, value FROM (SELECT days.date, rates.value, row_number() OVER (PARTITION BY days.date ORDER BY d DESC) AS k FROM days JOIN rates ON d <= date) WHERE k = 1""")
def rate_schedule_asof(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    entries = spark.sql("SELECT * FROM VALUES (DATE '1900-01-01', 10.0D), (DATE '1996-06-15', 15.0D), (DATE '1998-03-02', 20.0D) AS x(effective_date, value)")
    return costs.rate_schedule(days, entries)


@query("""SELECT e.event_id, p.value AS last_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_backward(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    return joins.asof_backward(e.select("event_id", "user_id", "ts"), right, "ts", ("user_id",), ("last_value",)).select("event_id", "last_value")


@query("""SELECT e.event_id, p.value AS next_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts <= p.ts""")
def asof_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("next_value"))
    return joins.asof_forward(e.select("event_id", "user_id", "ts"), right, "ts", ("user_id",), ("next_value",)).select("event_id", "next_value")


_WINDOWS = "m AS (SELECT ticker, min(date) + 100 AS start, CASE WHEN ticker LIKE '%0' THEN max(date) - 200 END AS stop FROM bars GROUP BY ticker)"


@query(sql("SELECT b.ticker, b.date, b.close FROM bars b JOIN m ON b.ticker = m.ticker AND b.date >= start AND (stop IS NULL OR b.date <= stop)", _WINDOWS))
def listing_window_join(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", "date", "close")
    m = b.groupBy("ticker").agg(F.date_add(F.min("date"), 100).alias("start"), F.when(F.col("ticker").endswith("0"), F.date_sub(F.max("date"), 200)).alias("stop"))
    return execution.listing_windows(b, m)


@query(sql("SELECT t, ticker, NOT (date BETWEEN DATE '1997-03-01' AND DATE '1997-06-30' OR date >= DATE '2001-01-01') OR ticker = 'S1' AS shortable FROM panel"))
def ban_range_join(spark, sf_dir):
    bans = spark.sql("SELECT * FROM VALUES (DATE '1997-03-01', DATE '1997-06-30'), (DATE '2001-01-01', CAST(NULL AS DATE)) AS x(start, stop)")
    return execution.shortable_from_bans(panel(spark, sf_dir).df.select("t", "date", "ticker"), bans, ["S1"]).select("t", "ticker", "shortable")


@query(sql("""SELECT y AS year, count(*) AS listed, count(*) FILTER (k % 2 = 0) AS in_panel, count(*) FILTER (year(stop) = y) AS stopped, count(*) FILTER (year(stop) = y AND k % 2 = 0) AS stopped_in_panel
FROM (SELECT ticker, min(k) AS k, min(date) AS start, CASE WHEN min(k) % 5 = 0 THEN max(date) - 700 END AS stop FROM bars GROUP BY ticker), (SELECT unnest([1996, 1998, 2000]) AS y) WHERE year(start) <= y AND (stop IS NULL OR year(stop) >= y) GROUP BY y"""))  # fmt: skip
def universe_coverage(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("k", F.expr("CAST(substring(ticker, 2) AS INT)"))
    m = b.groupBy("ticker").agg(F.min("date").alias("start"), F.when(F.min("k") % 5 == 0, F.date_sub(F.max("date"), 700)).alias("stop"))
    return long_table.universe_coverage(b.where("k % 2 = 0").select("ticker"), m, [1996, 1998, 2000])


@query("""SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS bar_end, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 4) AS volume, count(*) AS n_min
FROM events WHERE value IS NOT NULL GROUP BY 1, 2 HAVING bar_end <= (SELECT max(ts) + INTERVAL 1 MINUTE FROM events WHERE value IS NOT NULL)""")
def bars_tumbling(spark, sf_dir):
    v = F.col("value")
    m = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("symbol"), "ts", v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), v.alias("volume"))
    return B.drop_partial(B.aggregate_bars(m, "1h"), m).withColumn("volume", r("volume", 4))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, s""")
def session_runs(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), "6 hours", "user_id")


@query("""SELECT symbol, bar_end, round(sum(rate), 8) + 0.0 AS rate FROM (SELECT event_type AS symbol, make_timestamp(CAST(ceil(round(epoch_us(ts) / 60000000.0) * 60 / 28800) AS BIGINT) * 28800 * 1000000) AS bar_end, value / 1e4 AS rate FROM events WHERE value IS NOT NULL) GROUP BY 1, 2""")
def funding_asof_forward(spark, sf_dir):
    s = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 1e4).alias("rate"))
    return B.funding_to_bars(s, 480).select("symbol", F.col("bar_end").cast("timestamp_ntz").alias("bar_end"), r("rate").alias("rate"))


@query("""SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS k FROM events) WHERE k = 1""")
def dedupe_last(spark, sf_dir):
    return B.keep_last(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts")


@query("""WITH d AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, count(*) >= (SELECT count(*) / 30.0 / count(DISTINCT event_type) FROM events) AS ok FROM events GROUP BY 1, 2),
b AS (SELECT DISTINCT event_type AS symbol, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS bar_end FROM events)
SELECT b.symbol, b.bar_end, coalesce(d.ok, false) AS eligible FROM b LEFT JOIN d ON d.symbol = b.symbol AND d.day + 1 = CAST(b.bar_end - INTERVAL 1 MINUTE AS DATE)""")
def next_day_eligibility(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "symbol")
    least = e.agg((F.count("*") / 30.0 / F.countDistinct("symbol")).alias("least"))
    d = e.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(least)).select("symbol", "day", (F.col("n") >= F.col("least")).alias("ok"))
    b = e.select("symbol", F.window("ts", "6 hours").alias("w")).select("symbol", F.col("w.end").alias("bar_end")).distinct()
    return B.next_day_eligibility(d, b).select("symbol", "bar_end", "eligible")


@query(sql("SELECT ticker, CASE WHEN c < 0 AND n >= 30 THEN round(2 * sqrt(-c), 4) END AS spread FROM (SELECT ticker, covar_samp(d, b) AS c, count(close) AS n FROM (SELECT *, lag(d) OVER (PARTITION BY ticker ORDER BY t) AS b FROM (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY t) AS d FROM panel WHERE close IS NOT NULL)) GROUP BY ticker)"))
def roll_spread(spark, sf_dir):
    return costs.roll_spread(panel(spark, sf_dir).df).select("ticker", r("spread", 4).alias("spread"))


@query(sql("SELECT CASE WHEN count(*) >= 20 THEN round(regr_intercept(y, x), 8) END AS a, CASE WHEN count(*) >= 20 THEN round(regr_slope(y, x), 8) END AS b FROM (SELECT ln(avg(close * volume)) AS x, ln(avg((high - low) / close) * 1e4) AS y FROM panel WHERE close > 0 GROUP BY ticker HAVING avg(high - low) > 0)"))
def spread_fit(spark, sf_dir):
    df = panel(spark, sf_dir).df.where("close > 0").groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("v"), (F.avg((F.col("high") - F.col("low")) / F.col("close")) * 1e4).alias("s"))
    return costs.fit_spread(df, "v", "s").select(r("a").alias("a"), r("b").alias("b"))


def _control_sql(name: str, x: str) -> str:
    return rank_cte(f"k_{name}", "cb", x)


_CONTROLS = {"rev1": "ret1", "rev5": "r5", "mom21": "r21", "mom252_21": "r52 - r21", "vol21": "s21", "logsize": "CASE WHEN mkt_cap > 0 THEN ln(mkt_cap) END", "turnover": "a21 / nullif(mkt_cap, 0)", "char_disc": "char_disc"}
_CONTROL_CTE = (
    f"cb AS (SELECT *, close / nullif(lag(close, 5) OVER ({WT}), 0) - 1 AS r5, close / nullif(lag(close, 21) OVER ({WT}), 0) - 1 AS r21, close / nullif(lag(close, 52) OVER ({WT}), 0) - 1 AS r52, {roll('stddev_samp(ret1)', 21)} AS s21, {roll('avg(close * volume)', 20)} AS a21 FROM panel), "
    + ", ".join(_control_sql(k, v) for k, v in _CONTROLS.items())
)


@query(sql("SELECT t, ticker, " + ", ".join(f"round((k_{k}.pr - 0.5) * sqrt(12), 8) + 0.0 AS c_{k}" for k in _CONTROLS) + " FROM k_rev1 " + " ".join(f"JOIN k_{k} USING (t, ticker)" for k in list(_CONTROLS)[1:]), _CONTROL_CTE))
def controls(spark, sf_dir):
    c = recipes.controls(panel(spark, sf_dir))
    return c.select("t", "ticker", *(r(f"c_{k}").alias(f"c_{k}") for k in _CONTROLS))


@query()
def neutralize(spark, sf_dir):
    c = recipes.controls(panel(spark, sf_dir))
    return recipes.neutralize(c.withColumn("f", F.col("c_mom21")), "f", ["c_rev1", "c_logsize"], 20)


@query()
def fm_controls(spark, sf_dir):
    p = panel(spark, sf_dir)
    c = recipes.controls(p).join(P.forward(p, 4).select("t", "ticker", "fwd"), ["t", "ticker"])
    return stats.fama_macbeth(c, "fwd", "c_rev5", ["c_logsize", "c_rev1"])


_IC = rank_cte("fa", f"(SELECT *, CAST(CAST(lead(close, 5) OVER ({WT}) / nullif(lead(close, 1) OVER ({WT}), 0) - 1 AS FLOAT) AS DOUBLE) AS fwd, -(close / nullif(lag(close, 5) OVER ({WT}), 0) - 1) AS factor FROM panel)", "factor", "eligible AND fwd IS NOT NULL AND factor IS NOT NULL")
_IC += ", " + rank_cte("fb", "(SELECT * EXCLUDE (v_), pr AS ra FROM (SELECT * EXCLUDE (pr), pr FROM fa))".replace("SELECT * EXCLUDE (v_), pr AS ra", "SELECT * EXCLUDE (v_, pr), pr AS ra"), "fwd", "ra IS NOT NULL")


def _factor(p):
    return P.forward(p, 4).withColumn("factor", recipes.reversal(5))


@query(sql("SELECT t, round(corr(ra, pr), 8) + 0.0 AS ic, count(ra) AS n FROM fb WHERE ra IS NOT NULL GROUP BY t HAVING count(ra) >= 20", _IC))
def ic_daily(spark, sf_dir):
    return event.ic_daily(_factor(panel(spark, sf_dir))).select("t", r("ic").alias("ic"), "n")


@query(sql("SELECT count(ic) AS days, round(avg(ic), 8) AS mean, round(stddev_samp(ic), 8) AS std, round(avg(CAST(ic > 0 AS INT)), 8) AS hit, round(avg(ic) / stddev_samp(ic), 8) AS icir FROM (SELECT t, corr(ra, pr) AS ic FROM fb WHERE ra IS NOT NULL GROUP BY t HAVING count(ra) >= 20)", _IC))
def ic_report(spark, sf_dir):
    a = event.ic_report(event.ic_daily(_factor(panel(spark, sf_dir))))
    return a.select("days", *(r(c).alias(c) for c in ("mean", "std", "hit", "icir")))


_DECILE = rank_cte("dr", f"(SELECT *, CAST(CAST(lead(close, 5) OVER ({WT}) / nullif(lead(close, 1) OVER ({WT}), 0) - 1 AS FLOAT) AS DOUBLE) AS fwd, -(close / nullif(lag(close, 5) OVER ({WT}), 0) - 1) AS factor FROM panel)", "factor")
_DECILE += """, dp AS (SELECT * FROM (SELECT *, avg(fwd) OVER (PARTITION BY t) AS m, count(*) OVER (PARTITION BY t) AS n FROM dr WHERE eligible AND fwd IS NOT NULL) WHERE n >= 30 AND pr IS NOT NULL),
db AS (SELECT bin, avg(e) * 1e4 AS excess_bp, count(*) AS days FROM (SELECT t, bin, avg(fwd) - any_value(m) AS e FROM (SELECT *, BINS AS bin FROM dp) GROUP BY t, bin HAVING count(*) >= 3) GROUP BY bin)""".replace("BINS", " + ".join(f"CASE WHEN pr >= {d / 10}::DOUBLE THEN 1 ELSE 0 END" for d in range(1, 10)))


@query(sql("SELECT CAST(bin AS INT) AS bin, round(excess_bp, 4) + 0.0 AS excess_bp, days FROM db", _DECILE))
def decile_profile(spark, sf_dir):
    return event.decile_profile(_factor(panel(spark, sf_dir))).select("bin", r("excess_bp", 4).alias("excess_bp"), "days")


@query(sql("SELECT round(corr(k, bin), 6) AS rho, round(max(excess_bp) FILTER (bin = 9) - max(excess_bp) FILTER (bin = 0), 4) AS spread_bp FROM (SELECT *, rank() OVER (ORDER BY excess_bp) AS k FROM db)", _DECILE))
def decile_shape(spark, sf_dir):
    return event.profile_shape(event.decile_profile(_factor(panel(spark, sf_dir)))).select(r("rho", 6).alias("rho"), r("spread_bp", 4).alias("spread_bp"))


_ONE = rank_cte("oa", f"(SELECT *, close / nullif(lag(close, 21) OVER ({WT}), 0) - 1 AS m21, CASE WHEN mkt_cap > 0 THEN ln(mkt_cap) END AS ls, CAST(CAST(lead(close, 5) OVER ({WT}) / nullif(lead(close, 1) OVER ({WT}), 0) - 1 AS FLOAT) AS DOUBLE) AS fwd FROM panel)", "m21")
_ONE += ", " + rank_cte("ob", "(SELECT * EXCLUDE (v_, pr), (pr - 0.5) * sqrt(12) AS f FROM oa)", "ls") + ", oc AS (SELECT t, ticker, eligible, fwd, f, (pr - 0.5) * sqrt(12) AS c FROM ob)"


@query(sql("SELECT t, ticker, round(f - a - b * c, 7) + 0.0 AS residual FROM (SELECT *, regr_intercept(f, c) OVER (PARTITION BY t) AS a, regr_slope(f, c) OVER (PARTITION BY t) AS b, count(*) OVER (PARTITION BY t) AS n FROM oc WHERE eligible AND f IS NOT NULL AND c IS NOT NULL) WHERE n >= 20", _ONE))
def neutralize_one(spark, sf_dir):
    """neutralize beside one control, which has a closed form."""
    c = recipes.controls(panel(spark, sf_dir))
    return recipes.neutralize(c, "c_mom21", ["c_logsize"], 20).select("t", "ticker", r("residual", 7).alias("residual"))


@query(sql("SELECT t, round(sum(e * fwd) / sum(e * e), 8) + 0.0 AS beta FROM (SELECT t, fwd, f - a - b * c AS e, n FROM (SELECT *, regr_intercept(f, c) OVER (PARTITION BY t) AS a, regr_slope(f, c) OVER (PARTITION BY t) AS b, count(*) OVER (PARTITION BY t) AS n FROM oc WHERE eligible AND f IS NOT NULL AND c IS NOT NULL AND fwd IS NOT NULL) WHERE n >= 30) GROUP BY t", _ONE))
def fm_one_control(spark, sf_dir):
    """fm_controls beside one control, which has a closed form."""
    p = panel(spark, sf_dir)
    c = recipes.controls(p).join(P.forward(p, 4).select("t", "ticker", "fwd"), ["t", "ticker"])
    return stats.fama_macbeth(c, "fwd", "c_mom21", ["c_logsize"]).where("beta IS NOT NULL").select("t", r("beta").alias("beta"))


@query(sql("SELECT t, round(regr_slope(fwd, factor), 8) + 0.0 AS slope, count(*) AS n FROM fa WHERE v_ IS NOT NULL GROUP BY t HAVING count(*) >= 20", _IC))
def fm_raw_slope(spark, sf_dir):
    x = _factor(panel(spark, sf_dir)).where("eligible AND fwd IS NOT NULL AND factor IS NOT NULL")
    return x.groupBy("t").agg(r(F.regr_slope("fwd", "factor")).alias("slope"), F.count("*").alias("n")).where("n >= 20")


assert PANEL
