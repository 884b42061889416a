"""Queries on sources: cleaning, long tables, listings, filing dates, archives, minute rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import panel as P
from ..sources import bars as B
from ..sources import long_table, markets
from .base import WT, bars, panel, query, r, sql, table
from .panel_queries import HALTED, halted_panel

def _k():
    return F.expr("CAST(substring(ticker, 2) AS INT)")


@query(sql("""SELECT t, ticker, CASE WHEN c > 0 OR t = min(CASE WHEN c = 0 AND t > lp THEN t END) OVER (PARTITION BY ticker) THEN c END AS close FROM (SELECT *, max(CASE WHEN c > 0 THEN t END) OVER (PARTITION BY ticker) AS lp FROM
(SELECT *, CASE WHEN (t + k) % 13 = 0 THEN 0.0 WHEN (t + k) % 17 = 0 THEN -close WHEN k % 7 = 0 AND t > 300 THEN 0.0 ELSE close END AS c FROM (SELECT *, CAST(substring(ticker, 2) AS INT) AS k FROM panel)))"""))
def clean_prices(spark, sf_dir):
    k, t = _k(), F.col("t")
    c = F.when((t + k) % 13 == 0, 0.0).when((t + k) % 17 == 0, -F.col("close")).when((k % 7 == 0) & (t > 300), 0.0).otherwise(F.col("close"))
    return P.clean_prices(panel(spark, sf_dir).df.withColumn("close", c)).select("t", "ticker", "close")


@query(sql(f"""SELECT t, ticker, CAST(CAST(lead(px, 5) OVER ({WT}) / nullif(lead(px, 1) OVER ({WT}), 0) - 1 AS FLOAT) AS DOUBLE) AS value FROM (SELECT *, CASE WHEN gone THEN last_value(close IGNORE NULLS) OVER ({WT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * (1 + -0.3::DOUBLE) ELSE close END AS px FROM hr)""", HALTED))
def forward_delisted(spark, sf_dir):
    return P.forward(halted_panel(panel(spark, sf_dir)), 4, -0.3).select("t", "ticker", F.col("fwd").alias("value"))


_LONG = """lo AS (SELECT ticker, date, close, volume, k % 10 = 0 AS e FROM bars WHERE NOT (k % 10 = 0 AND date > DATE '1999-01-01')), ll AS (SELECT *, max(date) OVER (PARTITION BY ticker) AS ld, max(date) OVER () AS en FROM lo),
lf AS (SELECT ticker, date, date = ld AND date_diff('day', ld, en) > 30 AS del, CASE WHEN date = ld AND date_diff('day', ld, en) > 30 AND e THEN close * (1 + -0.25::DOUBLE) ELSE close END AS close FROM ll),
lc AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT date FROM lo))"""


@query(sql("SELECT t, ticker, close, close IS NOT NULL AND count(close) OVER (PARTITION BY ticker ORDER BY t) >= 20 AS eligible, coalesce(del, false) AS delist_after FROM lc CROSS JOIN (SELECT DISTINCT ticker FROM lo) LEFT JOIN lf USING (date, ticker)", _LONG))
def panel_from_long(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("k", _k()).where(~((F.col("k") % 10 == 0) & (F.col("date") > F.lit(dt.date(1999, 1, 1)))))
    b = b.select(F.col("ticker").alias("id"), "date", "close", "volume", F.when(F.col("k") % 10 == 0, -0.25).alias("dl"))
    p = long_table.panel_from_long(b, delist_return_col="dl", min_age=20)
    return p.df.select("t", "ticker", "close", "eligible", "delist_after")


_LISTED = """ms AS (SELECT ticker, min(date) + 100 AS start, CASE WHEN ticker LIKE '%0' THEN max(date) - 200 END AS stop FROM bars GROUP BY ticker), li AS (SELECT b.ticker, b.date, b.close FROM bars b JOIN ms ON b.ticker = ms.ticker AND b.date >= start AND (stop IS NULL OR b.date <= stop)),
lk AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT date FROM li GROUP BY date HAVING count(*) >= 3)), lx AS (SELECT t, x.ticker, li.close, ms.stop FROM lk CROSS JOIN (SELECT DISTINCT li.ticker FROM li JOIN lk USING (date)) x LEFT JOIN li ON li.date = lk.date AND li.ticker = x.ticker JOIN ms ON ms.ticker = x.ticker)"""


@query(sql("SELECT t, ticker, close, close IS NOT NULL AND count(close) OVER (PARTITION BY ticker ORDER BY t) >= 10 AS eligible, stop IS NOT NULL AND t = lt AND lt < e AS delist_after FROM (SELECT *, max(CASE WHEN close IS NOT NULL THEN t END) OVER (PARTITION BY ticker) AS lt, max(t) OVER () AS e FROM lx)", _LISTED))
def listed_panel(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", "date", "close")
    m = b.groupBy("ticker").agg(F.date_add(F.min("date"), 100).alias("start"), F.when(F.col("ticker").endswith("0"), F.date_sub(F.max("date"), 200)).alias("stop"))
    return markets.listed_panel(b, m, least_bars=3, min_age=10).df.select("t", "ticker", "close", "eligible", "delist_after")


@query("""SELECT date, (SELECT list_sort(list(CAST(x AS DATE)))[45] FROM generate_series(CASE isodow(date) WHEN 6 THEN date - 1 WHEN 7 THEN date - 2 ELSE date END + INTERVAL 1 DAY, date + INTERVAL 80 DAY, INTERVAL 1 DAY) s(x) WHERE isodow(x) < 6) AS known FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)""")
def business_days(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return d.select("date", markets.business_days_after("date", 45).alias("known"))


@query("""WITH a AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, round(sum(value), 4) AS close FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT symbol, date, CASE WHEN date >= DATE '2024-01-15' THEN close + 1 ELSE close END AS close FROM a WHERE date < DATE '2024-01-25'""")
def top_up(spark, sf_dir):
    a = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date")).agg(r(F.sum("value"), 4).alias("close"))
    live = a.where(F.col("date") >= F.lit(dt.date(2024, 1, 15))).withColumn("close", F.col("close") + 1)
    return B.top_up(a.where(F.col("date") <= F.lit(dt.date(2024, 1, 20))), live, dt.date(2024, 1, 25))


@query("SELECT event_type AS symbol, CAST(ts AS DATE) AS date, round(sum(value / 1e4), 8) + 0.0 AS rate FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def daily_funding(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("symbol"), "ts", (F.col("value") / 1e4).alias("rate"))
    return B.daily_funding(e).select("symbol", "date", r("rate").alias("rate"))


@query("""SELECT symbol, bar_end, close FROM (SELECT event_type AS symbol, make_timestamp((epoch_us(ts) // 1000) * 1000) + INTERVAL 1 MINUTE AS bar_end, value AS close, row_number() OVER (PARTITION BY event_type, (epoch_us(ts) // 1000) ORDER BY CASE WHEN event_id % 2 = 0 THEN (epoch_us(ts) // 1000) ELSE (epoch_us(ts) // 1000) * 1000 END DESC, event_id) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1""")
def minute_rows(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 2 == 0, ms).otherwise(ms * 1000).alias("open_time"), F.col("value").alias("close"), *(F.lit(0.0).alias(c) for c in ("open", "high", "low", "volume", "quote_volume", "trades")))
    return B.minute_bars(e).select("symbol", F.col("bar_end").cast("timestamp_ntz").alias("bar_end"), "close")


@query("SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20') WHERE k = 1")
def half_open_time(spark, sf_dir):
    e = B.between(table(spark, sf_dir, "events"), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20), "ts")
    return B.keep_last(e, ["user_id"], "ts").select("user_id", "ts", "event_id")
