"""Sources, ledger and streams on hand-made rows."""

import datetime as dt
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.operators import costs, recipes
from tidemark.sources import bars as B
from tidemark.sources import ledger, long_table, markets
from tidemark.streaming import bars as S


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_long_table_columns(spark):
    rows = [("a", day(i), 10.0, 5.0, 9.0, 11.0, 8.0, 1e6, i != 70) for i in range(80)] + [("b", day(i), 10.0, 5.0, 9.0, 11.0, 8.0, 1e6, True) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, date date, close double, volume double, o double, h double, l double, cap double, inside boolean")
    p = long_table.panel_from_long(df, open_col="o", high_col="h", low_col="l", mkt_cap_col="cap", in_universe_col="inside", min_age=10)
    assert {"open", "high", "low", "mkt_cap"} <= set(p.df.columns) and "_in" not in p.df.columns
    assert p.meta["rows"] == 100 and p.meta["ended"] == 1 and p.meta["delist_returns"] == 0
    a = {x["t"]: x["eligible"] for x in p.df.where("ticker = 'a'").collect()}
    assert not a[8] and a[9] and not a[70] and a[71]
    with pytest.raises(KeyError):
        long_table.panel_from_long(df, open_col="nope")


def test_exchange_panel(spark):
    raw = [("000010", "One", "K", str(1000 + i), "10" if i != 50 else "-520", "1,000", "0", "-", "100", "9", day(i)) for i in range(100)]
    raw += [("000015", "One preferred", "K", "500", "0", "1", "1", "1", "5", "9", day(i)) for i in range(100)]
    raw += [("000020", "Blank SPAC 3", "K", "500", "0", "1", "1", "1", "5", "9", day(i)) for i in range(100)]
    raw += [("000030", "Old", "Q", "500", "0", "1", "1", "1", "5", "9", day(i)) for i in range(40)] + [("000030", "New", "Q", "900", "0", "1", "1", "1", "5", "9", day(i)) for i in range(200, 210)]
    names = {"c": "ticker", "n": "name", "m": "market", "x": "close", "d": "change", "o": "open", "h": "high", "l": "low", "v": "volume", "k": "mkt_cap"}
    df = long_table.day_rows(spark.createDataFrame(raw, "c string, n string, m string, x string, d string, o string, h string, l string, v string, k string, date date").withColumn("day", F.col("date").cast("string")), names | {"day": "date"}, ("close", "change", "open", "high", "low", "volume", "mkt_cap")).withColumn("date", F.to_date("date"))
    one = df.where("ticker = '000010'").orderBy("date").first()
    assert one["open"] == 1000.0 and one["low"] is None
    p = long_table.exchange_panel(df, min_age=5, excluded_names="SPAC", drop_suspect_above=0.3, ended_gap_days=30)
    assert {x["ticker"] for x in p.df.select("ticker").distinct().collect()} == {"000010", "000030", "000030~1"}
    assert [x[0] for x in p.meta["suspect"]] == ["000010"] and p.market == "KR"
    close = {x["date"]: x["close"] for x in p.df.where("ticker = '000010' AND close IS NOT NULL").collect()}
    assert close[day(0)] == 100.0 and close[day(1)] == pytest.approx(100 * 1001 / 991) and close[day(50)] == close[day(49)]
    assert p.df.where("delist_after").select("ticker").distinct().count() == 2


def test_master_and_windows(spark):
    rows = [("AAA", "NYSE", "Stock", "2001-01-01", "2024-01-05"), ("BBB", "NYSE", "Stock", "2001-01-01", "2010-01-01"), ("C.D", "NYSE", "Stock", "2001-01-01", "2024-01-05"), ("ETF", "NYSE", "ETF", "2001-01-01", "2024-01-05"), ("OTC", "PINK", "Stock", "2001-01-01", "2024-01-05"), ("NON", "NYSE", "Stock", None, None)]
    m = long_table.stock_master(spark.createDataFrame(rows, "ticker string, exchange string, assetType string, startDate string, endDate string"), ("NYSE", "NASDAQ"))
    assert {x["ticker"]: x["alive_today"] for x in m.collect()} == {"AAA": True, "BBB": False}
    b = spark.createDataFrame([(day(i), "AAA", 10.0, 5.0, 100.0) for i in range(10)], "date date, ticker string, close double, adj_close double, volume double")
    p = markets.listed_panel(b, spark.createDataFrame([("AAA", day(2), None)], "ticker string, start date, stop date"), least_bars=1, min_age=2, min_price=9.0)
    assert p.df.count() == 8 and p.df.where("close = 5.0 AND raw_close = 10.0").count() == 8 and p.df.where("eligible").count() == 7


def test_business_days_and_filings(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(14)]

    def after(d, n):
        while d.weekday() > 4:
            d -= dt.timedelta(days=1)
        while n:
            d += dt.timedelta(days=1)
            n -= d.weekday() < 5
        return d

    for n in (1, 5, 45):
        got = spark.createDataFrame([(d,) for d in days], "d date").select("d", markets.business_days_after("d", n).alias("x")).collect()
        assert all(r["x"] == after(r["d"], n) for r in got)
    q = spark.createDataFrame([("A", day(0), 1.0, None), ("A", day(90), 2.0, 7.0)], "ticker string, date date, x double, y double")
    a = spark.createDataFrame([("A", day(0), 9.0, 5.0), ("A", day(300), 4.0, 6.0)], "ticker string, date date, x double, y double")
    assert sorted(tuple(r)[1:] for r in markets.filings(q, a, ("x", "y")).collect()) == [(day(0), 1.0, 5.0), (day(90), 2.0, 7.0), (day(300), 4.0, 6.0)]
    cells = spark.createDataFrame([("A", day(i), 1.0) for i in (0, 62, 63, 200)], "ticker string, date date, close double")
    c = {r["date"]: r["char_x"] for r in markets.characteristics(cells, q, ("x", "y"), 45, 0.3).collect()}
    assert c[day(62)] is None and c[day(63)] == 1.0 and c[day(200)] == 2.0


def test_financials(spark):
    df = spark.createDataFrame([(t, "A", 10.0 + t, 100.0, 50.0, 5.0, 80.0) for t in range(3)] + [(3, "A", 13.0, 0.5, -1.0, None, 0.0)], "t int, ticker string, close double, mkt_cap double, equity double, net_income double, assets double")
    x = recipes.characteristics_from_financials(df).orderBy("t").collect()
    assert x[0]["char_log_bm"] == pytest.approx(-0.6931, abs=1e-4) and x[0]["char_roa"] == 0.0625 and x[3]["char_log_size"] == 0.0 and x[3]["char_roa"] is None and x[3]["char_log_bm"] == pytest.approx(-13.8155, abs=1e-4)
    assert recipes.describe("size")["needs"] == ["mkt_cap"]
    with pytest.raises(ValueError):
        recipes.recipe("momentum", 252, skip=300)
    with pytest.raises(KeyError):
        recipes.recipe("nope")


def test_coins(spark):
    rows = [(day(i), n, 10.0 + k + (i * (k + 1)) % 5, 1.0 if not (n == "DEAD" and i > 60) else 0.0, 100.0 * (k + 1)) for i in range(90) for k, n in enumerate(["BTC", "ETH", "DEAD"]) if not (n == "DEAD" and i > 70)]
    b = spark.createDataFrame(rows, "date date, ticker string, close double, volume double, quote_volume double")
    p = markets.coin_panel(b, top_n=2, min_age=10, turnover_window=5, market="BTC")
    assert [(x["ticker"], x["t"]) for x in p.df.where("delist_after").collect()] == [("DEAD", 60)]
    beta = {(x["ticker"], x["t"]): x["char_beta"] for x in p.df.collect()}
    assert beta["BTC", 80] == pytest.approx(1.0) and beta["ETH", 30] is None
    alive = markets.coin_panel(b, top_n=None, min_age=10, survivors_only=True)
    assert {x[0] for x in alive.df.select("ticker").distinct().collect()} == {"BTC", "ETH"}


def test_archives(spark, tmp_path):
    today = dt.date(2024, 3, 3)
    got = B.archive_paths("r", "X", dt.date(2024, 1, 15), dt.date(2024, 3, 10), today)
    assert got == ["r/monthly/X/X-2024-01.zip", "r/monthly/X/X-2024-02.zip", "r/daily/X/X-2024-03-01.zip", "r/daily/X/X-2024-03-02.zip"]
    old = spark.createDataFrame([("X", day(0), 1.0), ("X", day(1), 2.0)], "symbol string, date date, close double")
    new = spark.createDataFrame([("X", day(1), 2.5), ("X", day(2), 3.0), ("X", day(3), 9.0)], "symbol string, date date, close double")
    assert sorted((r["date"], r["close"]) for r in B.top_up(old, new, day(3)).collect()) == [(day(0), 1.0), (day(1), 2.5), (day(2), 3.0)]
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("f.csv", "calc_time,interval,rate\n1704067200000,8,0.0001\n1704096000000,8,0.0002\n")
    f = B.read_funding_zips(spark, str(tmp_path)).select(F.lit("X").alias("symbol"), "ts", "rate")
    assert [(r["date"], round(r["rate"], 6)) for r in B.daily_funding(f).collect()] == [(day(0), 0.0003)]
    k = spark.createDataFrame([("X", 1704067200000, 1.0), ("X", 1704067200000000, 2.0), ("X", 1704067260000, None)], "symbol string, open_time long, close double")
    for c in ("open", "high", "low", "volume", "quote_volume", "trades"):
        k = k.withColumn(c, F.lit(1.0))
    m = B.minute_bars(k).collect()
    assert len(m) == 1 and m[0]["close"] == 2.0 and m[0]["bar_end"].minute == 1
    assert B.between(B.minute_bars(k), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 1)).count() == 1 and B.between(B.minute_bars(k), dt.datetime(2024, 1, 1, 0, 1), dt.datetime(2024, 1, 2)).count() == 0
    rules = spark.createDataFrame([("X", 0.5, 5.0, 0.1)], "symbol string, lot double, min_notional double, tick double")
    want = spark.createDataFrame([("X",), ("Y",)], "ticker string")
    assert {r["ticker"]: r["lot"] for r in B.execution_rules(rules, want, "null").collect()} == {"X": 0.5, "Y": None}
    with pytest.raises(ValueError, match="Y"):
        B.execution_rules(rules, want)


def test_minute_panel(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for k, (name, until, each) in enumerate([("A", 8 * 24, 100.0), ("B", 8 * 24, 10.0), ("C", 3 * 24, 50.0)]):
        rows += [(name, t0 + dt.timedelta(hours=h), 10.0 + k + h % 3, 1.0, each if h < until else 0.0) for h in range(8 * 24 if name != "C" else until + 5)]
    m = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume double, quote_volume double")
    for c in ("open", "high", "low"):
        m = m.withColumn(c, F.col("close"))
    paid = spark.createDataFrame([("A", t0 + dt.timedelta(days=4, seconds=2), 0.01), ("A", t0 + dt.timedelta(days=4, hours=7, minutes=59), 0.02)], "symbol string, ts timestamp, rate double")
    p = markets.minute_panel(m, day(3), day(7), bar="4h", adv_window=2, min_age_days=2, min_value=300.0, settlements=paid, ended_days=3)
    assert p.periods_per_year == 365 * 6 and p.df.select("t").distinct().count() == 30
    x = {(r["ticker"], r["t"]): r for r in p.df.collect()}
    assert all(x["A", t]["eligible"] for t in range(30)) and not any(x["B", t]["eligible"] for t in range(30))
    assert x["A", 5]["funding"] == pytest.approx(0.01) and x["A", 7]["funding"] == pytest.approx(0.02)
    top = markets.minute_panel(m, day(2), day(7), bar="4h", adv_window=1, min_age_days=1, min_value=1.0, top_n=1)
    assert {r["ticker"] for r in top.df.where("eligible").collect()} == {"A"} and [(r["ticker"], r["date"]) for r in top.df.where("delist_after").collect()] == [("C", t0 + dt.timedelta(days=3))]


def test_spread_estimate_in_costs(spark):
    rows = [(t, "A", 10.0, 10.2, 9.8, 100.0) for t in range(40)]
    df = spark.createDataFrame(rows, "t int, ticker string, close double, high double, low double, volume double").withColumn("cs", costs.corwin_schultz())
    fixed = df.select(markets.liquidity_cost_bp().alias("c")).agg(F.max("c")).first()[0]
    wide = df.select("t", markets.liquidity_cost_bp(window=10, spread="corwin_schultz").alias("c")).agg(F.max("c")).first()[0]
    assert fixed == 7.0 and wide > fixed
    with pytest.raises(ValueError):
        markets.liquidity_cost_bp(spread="other")


def test_ledger_takes_writers_in_turn(spark, tmp_path):
    book = ledger.Ledger(str(tmp_path / "l"))
    frames = [spark.createDataFrame([(day(i), 0.01 * ((i * (k + 1)) % 5 - 1.5)) for i in range(40)], "date date, ret double") for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: book.record("f", f"n{k}", {"k": k}, frames[k]), range(4)))
    assert book.verify() and len(book.trials("f")) == 4 and not book.trials("g")
    assert 0 <= book.deflated_sharpe(spark)["dsr"] <= 1
    a = ledger.array_fingerprint(frames[0])
    assert a == ledger.array_fingerprint(frames[0].repartition(3)) != ledger.array_fingerprint(frames[1])


def ran(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 2)
    rows = [("A", t0 + dt.timedelta(minutes=i), float(i), k) for i in range(5) for k in (1, 2)]
    minutes = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, _seen int")
    minutes.coalesce(1).write.parquet(str(tmp_path / "m"))
    read = lambda path, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / path))
    got = ran(S.latest(read("m", minutes), ["symbol", "ts"], "ts", "1 minute"), "latest")
    assert {r["ts"].minute for r in got} <= {0, 1, 2, 3} and len(got) >= 3 and all(r["_seen"] == 2 for r in got)  # the last minute stays open
    with pytest.raises(ValueError):
        S.latest(minutes, ["symbol"], "ts", "0 seconds")
    bars = minutes.where("_seen = 1").select("symbol", F.col("ts").alias("bar_end"))
    bars.write.parquet(str(tmp_path / "b"))
    daily = spark.createDataFrame([("A", dt.date(2024, 1, 1), True), ("A", dt.date(2023, 12, 31), False)], "symbol string, day date, ok boolean")
    got = {r["bar_end"].minute: r["eligible"] for r in ran(S.with_daily(read("b", bars), daily), "eligible")}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: True}
    target = spark.createDataFrame([("A", t, w, b, s) for t, (w, b, s) in enumerate([(0.5, True, True), (0.8, False, True), (0.2, True, False), (0.1, True, True)])], "ticker string, t long, w double, can_buy boolean, can_sell boolean")
    for i in range(4):  # one file a day
        target.where(F.col("t") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    got = sorted((r["t"], r["h"]) for r in ran(S.fills(read("t", target)), "fills"))
    assert got == [(0, 0.5), (1, 0.5), (2, 0.5), (3, 0.1)]
