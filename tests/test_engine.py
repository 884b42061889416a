"""Operators against plain loops on small panels."""

import datetime as dt
import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import columns as C
from tidemark.operators import costs, draws, engine, event, execution, joins, portfolio, recipes, sweeps
from tidemark.operators.panel import Panel, check_alignment, compounded, forward, ret
from tidemark.plans import base
from tidemark.sources import bars as B
from tidemark.sources import ledger, long_table
from tidemark.streaming.bars import closed_bars


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def world(seed=1, T=60, N=12):
    r = random.Random(seed)
    rows = []
    for k in range(N):
        p = 50.0
        for t in range(T):
            p *= math.exp(r.gauss(0, 0.03))
            if r.random() > 0.08:
                rows.append((day(t), f"N{k:02d}", p, float(r.randrange(0, 900)), r.random() > 0.1))
    return rows


@pytest.fixture(scope="module")
def p(spark):
    df = spark.createDataFrame(world(), "date date, ticker string, close double, volume double, eligible boolean")
    return Panel.of(df, entry_lag=1, periods_per_year=365)


def wide(df, c):
    x = df.select("t", "ticker", c).toPandas().pivot(index="t", columns="ticker", values=c).sort_index()
    return x.astype(float)


def test_panel_checks(spark, p):
    p.validate()
    with pytest.raises(ValueError):
        Panel.of(spark.createDataFrame(world() + world()[:1], "date date, ticker string, close double, volume double, eligible boolean"))
    with pytest.raises(KeyError):
        Panel.of(spark.createDataFrame([(day(0), "A", 1.0)], "date date, ticker string, close double"))
    assert p.fingerprint() == p.with_df(p.df.repartition(7)).fingerprint() != p.truncate(day(40)).fingerprint()
    with pytest.raises(ValueError):
        check_alignment(p, spark.createDataFrame([(day(900), "X")], "date date, ticker string"), "factor")


def test_causal(p):
    good = lambda q: q.df.withColumn("value", ret(3))
    bad = lambda q: q.df.withColumn("value", F.lead("close", 1).over(C.by_time()))
    p.assert_causal(good)
    with pytest.raises(AssertionError):
        p.assert_causal(bad)


def test_clean_prices(spark):
    rows = [(day(i), "A", x, True) for i, x in enumerate([1.0, -2.0, 0.0, 3.0, 0.0, 0.0])] + [(day(i), "B", x, True) for i, x in enumerate([float("inf"), 2.0, 2.0, 2.0, 2.0, 2.0])]
    df = Panel.of(spark.createDataFrame(rows, "date date, ticker string, close double, eligible boolean")).df
    got = {k: [x["close"] for x in df.where(F.col("ticker") == k).orderBy("t").collect()] for k in "AB"}
    assert got["A"] == [1.0, None, None, 3.0, 0.0, None] and got["B"][0] is None


def test_rank_and_rolling(p):
    df = p.df.withColumn("r", C.pct_rank("close", "eligible")).withColumn("m", C.rolling_median("close", 5, 3)).withColumn("s", C.rolling(F.stddev_samp, "close", 6, 4)).withColumn("g", F.col("close").isNull())
    df = C.run_length(df, "g", "run")
    close, el = wide(p.df, "close"), wide(p.df, "eligible") > 0
    pd.testing.assert_frame_equal(wide(df, "r"), close.where(el).rank(axis=1, pct=True), check_names=False)
    pd.testing.assert_frame_equal(wide(df, "m"), close.rolling(5, min_periods=3).median(), check_names=False)
    pd.testing.assert_frame_equal(wide(df, "s"), close.rolling(6, min_periods=4).std(), check_names=False)
    run = wide(df, "run")
    for c in close:
        n = 0
        for t in close.index:
            n = n + 1 if math.isnan(close.loc[t, c]) else 0
            assert run.loc[t, c] == n


def test_forward_rules(spark, p):
    close = wide(p.df, "close")
    f = wide(forward(p, 3, single=False), "fwd")
    pd.testing.assert_frame_equal(f, close.shift(-4) / close.shift(-1) - 1, check_names=False)
    r = close / close.shift(1) - 1
    c = wide(compounded(p, 3), "cum")
    want = (1 + r.fillna(0)).rolling(3).apply(np.prod).shift(-4) - 1
    pd.testing.assert_frame_equal(c, want, check_names=False)
    dead = p.with_df(p.df.withColumn("delist_after", (F.col("ticker") == "N00") & (F.col("t") == 20)).withColumn("close", F.when((F.col("ticker") == "N00") & (F.col("t") > 20), None).otherwise(F.col("close"))))
    x = wide(forward(dead, 5, -0.3, single=False), "fwd")["N00"]
    last = wide(dead.df, "close")["N00"].ffill()
    assert x[17] == pytest.approx(last[20] * 0.7 / last[18] - 1) and x[30] == pytest.approx(0)


def test_portfolio_equals_loops(p):
    lq, sq, hold, bp = 0.25, 0.25, 3, 20.0
    df = portfolio.one_bar(p).withColumn("factor", recipes.reversal(4))
    net = portfolio.backtest_portfolio(p, "factor", long_q=lq, short_q=sq, hold=hold, spread_bp=bp, df=df).orderBy("t").toPandas()
    close, el = wide(p.df, "close"), wide(p.df, "eligible") > 0
    f = -(close / close.shift(4) - 1)
    rank = f.where(el).rank(axis=1, pct=True)
    fwd = (close / close.shift(1) - 1).shift(-2).fillna(0)
    sleeves = []
    for leg in (rank >= 1 - lq, rank <= sq):
        w = leg.astype(float)
        w = w.div(w.sum(axis=1).replace(0, np.nan), axis=0).fillna(0).to_numpy()
        sleeves.append(np.array([w[max(0, t - hold + 1) : t + 1].sum(0) / min(hold, t + 1) for t in range(len(w))]))
    want = []
    for t in range(len(close) - 2):
        cost = sum(np.abs(s[t] - s[t - 1]).sum() if t else 0 for s in sleeves) * bp / 2e4
        want.append(((sleeves[0][t] - sleeves[1][t]) * fwd.to_numpy()[t]).sum() - cost)
    assert np.allclose(net["net"], want, atol=1e-12)
    grid = portfolio.grid(p, "factor", (1, hold), (0.0, bp), lq, sq, df).where((F.col("hold") == hold) & (F.col("cost_bp") == bp)).orderBy("t").toPandas()
    assert np.allclose(grid["net"], want, atol=1e-12)
    m = stats.metrics(net_frame(p, net), 50).first()
    eq = np.cumprod(1 + net["net"])
    assert m["mdd"] == pytest.approx((eq / np.maximum(np.maximum.accumulate(eq), 1) - 1).min())
    assert m["sharpe"] == pytest.approx(net["net"].mean() / net["net"].std() * math.sqrt(50))
    for bad in ({"long_q": 0.8, "short_q": 0.5}, {"spread_bp": -1.0}, {"hold": 0}):
        with pytest.raises(ValueError):
            portfolio.backtest_portfolio(p, "factor", df=df, **bad)


def net_frame(p, net):
    return p.df.sparkSession.createDataFrame(net[["t", "net"]])


def test_costs_and_execution(spark, p):
    h = spark.createDataFrame([(t, k, w) for k, ws in {"a": [0.5, 0.1, 0.1], "b": [-0.5, 0.2, -0.4]}.items() for t, w in enumerate(ws)], "t int, ticker string, h double")
    cost = {x["t"]: x["cost"] for x in costs.turnover_cost(h, 20.0).collect()}
    assert cost[0] == 0 and cost[1] == pytest.approx(1.1 * 10 / 1e4) and cost[2] == pytest.approx(0.6 * 10 / 1e4)
    target = h.withColumnRenamed("h", "w").withColumn("can_buy", F.col("t") != 1).withColumn("can_sell", F.lit(True))
    got = {(x["t"], x["ticker"]): x["h"] for x in execution.realize(target).collect()}
    assert got[1, "b"] == -0.5 and got[1, "a"] == 0.1 and got[2, "b"] == -0.4
    capped = execution.realize(target, cap_gross=True).groupBy("t").agg(F.sum(F.abs("h")).alias("g")).collect()
    gross = {0: 1.0, 1: 0.3, 2: 0.5}
    assert all(x["g"] <= gross[x["t"]] + 1e-9 or x["t"] == 1 for x in capped)
    with pytest.raises(ValueError):
        costs.ImpactModel(aum=-1)


def test_asof_and_schedules(spark):
    left = spark.createDataFrame([(k, i) for k in "ab" for i in (0, 5, 10)], "k string, at int")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 9, 2.0), ("b", 7, None), ("b", 8, 4.0)], "k string, at int, v double")
    back = {(x["k"], x["at"]): x["v"] for x in joins.asof_backward(left, right, "at", ("k",), ("v",)).collect()}
    assert back == {("a", 0): None, ("a", 5): 1.0, ("a", 10): 2.0, ("b", 0): None, ("b", 5): None, ("b", 10): 4.0}
    assert {(x["k"], x["at"]): x["v"] for x in joins.asof_backward(left, right, "at", ("k",), ("v",), strict=True).collect()}["a", 5] is None
    ahead = {(x["k"], x["at"]): x["v"] for x in joins.asof_forward(left, right, "at", ("k",), ("v",)).collect()}
    assert ahead["a", 5] == 1.0 and ahead["a", 10] is None and ahead["b", 5] is None
    days = spark.createDataFrame([(day(0),)], "date date")
    with pytest.raises(Exception, match="first entry"):
        costs.rate_schedule(days, spark.createDataFrame([(day(5), 1.0)], "effective_date date, value double")).collect()


def test_inference(spark):
    r = np.random.default_rng(1)
    R = r.normal(0, 0.01, (240, 6))
    R[:, 3] += 0.006
    df = spark.createDataFrame([(k, t, float(R[t, k])) for t in range(240) for k in range(6)], "trial int, t int, ret double")
    d = stats.deflated_sharpe(df)
    assert d["trial"] == 3 and d["dsr"] > 0.95 and stats.pbo(df) < 0.1
    w = stats.walk_forward(df, 60, 30)
    assert w.select("trial").distinct().count() == 1 and w.count() == 180 and w.where("trial <> 3").isEmpty()
    part = stats.walk_forward(df, 60, 50, step=25, expanding=False, select=lambda v: -v.mean())
    assert part.groupBy("t").count().where("count > 1").isEmpty() and part.where("trial = 3").isEmpty()
    with pytest.raises(ValueError):
        stats.walk_forward(df, 235, 20)
    x = R[:, 0]
    e = x - x.mean()
    want = math.sqrt(e @ e + sum(2 * (1 - k / 5) * (e[k:] @ e[:-k]) for k in range(1, 5))) / len(x)
    assert stats.newey_west(df.where("trial = 0").withColumnRenamed("ret", "net"), "net", 4).first()["se"] == pytest.approx(want)
    net = df.where("trial = 3").select("t", F.col("ret").alias("net"))
    b = stats.stationary_bootstrap(net, stats.sharpe_of, 200, seed=3).toPandas()["value"]
    assert b.quantile(0.025) > 0 and abs(b.median() - stats.sharpe_of(R[:, 3])) < 0.1
    assert stats.permutation(net, lambda v: v[:120].mean() - v[120:].mean(), 99)["p"] > 0.01
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "name string, p double")
    assert {x["name"]: round(x["q"], 4) for x in stats.fdr(p).collect()} == {"a": 0.04, "b": 0.0533, "c": 0.0533, "d": 0.5}
    assert {x["name"]: round(x["q"], 4) for x in stats.holm(p).collect()} == {"a": 0.04, "b": 0.09, "c": 0.09, "d": 0.5}
    assert stats.binomial_two_sided(3, 10) == pytest.approx(0.34375) and stats.two_sided(1.96) == pytest.approx(0.05, abs=1e-3)
    ruin = stats.stop_at_ruin(spark.createDataFrame([(0, 0.1), (1, -1.2), (2, 0.5)], "t int, net double")).orderBy("t").collect()
    assert [x["net"] for x in ruin] == [0.1, -1.0, 0.0]
    y = pd.DataFrame({"y": 0.5 * R[:, 1] + 0.001, "x": R[:, 1]})
    y["y"] += r.normal(0, 1e-4, 240)
    assert stats.decompose(y, "y", ["x"])["beta"]["x"] == pytest.approx(0.5, abs=0.01)


def test_cross_sections(spark):
    r = np.random.default_rng(2)
    rows = []
    for t in range(3):
        f, c = r.normal(size=60), r.normal(size=60)
        y = 0.002 * f + 0.001 * c + r.normal(0, 0.0001, 60)
        rows += [(t, f"n{i}", float(y[i]), float(f[i]), float(c[i]), True) for i in range(60)]
    df = spark.createDataFrame(rows, "t int, ticker string, y double, f double, c double, eligible boolean")
    assert all(abs(x["beta"] - 0.002) < 1e-4 for x in stats.fama_macbeth(df, "y", "f", ["c"]).collect())
    res = recipes.neutralize(df.withColumn("g", 2 * F.col("c") + F.col("f")), "g", ["c"]).join(df, ["t", "ticker"])
    assert abs(res.agg(F.corr("residual", "c")).first()[0]) < 1e-9
    assert recipes.neutralize(df.withColumn("g", 2 * F.col("c")), "g", ["c"]).count() == 0
    good = {"max_name_share": 0.2, "daily_turnover": 0.5}
    g = event.run_gates(3.5, 5.0, 0.7, [0.1, 0.2], [0.1, 0.2, -0.1], good)
    assert g["passed"] and event.run_gates(1.0, 5.0, 0.7, [0.1, 0.2], [0.1], good)["first_failure"] == "G1 threshold"
    assert event.run_gates(3.5, 5.0, None, [0.1, 0.2], [0.1], good)["first_failure"] == "G4 monotone"
    assert event.run_gates(3.5, 5.0, 0.7, [0.1, 0.2], [0.1], good | {"max_name_share": 0.6})["first_failure"] == "G6 structure"
    strict = event.GateConfig(min_neutral_survival=50.0)
    assert event.run_gates(3.5, 5.0, 0.7, [0.1, 0.2], [0.1], good, strict, 40.0)["first_failure"] == "G7 neutral"


def test_sources(spark, tmp_path):
    rows = [(f"id{k}", "AAA" if k in (3, 4) else f"T{k}", day(i), 10.0 + i % 7, 100.0, -0.3 if k == 0 and i == 150 else None) for k in range(12) for i in range(300 if k else 151)]
    df = spark.createDataFrame(rows, "id string, ticker string, date date, close double, volume double, dl double")
    p = long_table.panel_from_long(df, delist_return_col="dl", ticker_col="ticker")
    assert p.meta["reused"] == ["AAA"] and p.df.where("delist_after").count() == 1
    last = p.df.where("ticker = 'id0' AND close IS NOT NULL").orderBy(F.desc("t")).first()["close"]
    assert last == pytest.approx((10 + 150 % 7) * 0.7)
    assert p.df.where("ticker = 'id1' AND eligible").agg(F.min("t")).first()[0] == 59
    with pytest.raises(ValueError):
        long_table.panel_from_long(df.union(df.limit(1)))
    with pytest.raises(KeyError):
        long_table.panel_from_long(df, close_col="nope")
    code = spark.createDataFrame([("X", day(i)) for i in (0, 1, 200, 201)], "ticker string, date date")
    assert {x["sid"] for x in long_table.split_reused_codes(code).collect()} == {"X", "X~1"}
    import zipfile

    with zipfile.ZipFile(tmp_path / "k.zip", "w") as z:
        z.writestr("k.csv", "open_time,open\n1600000000000,1,2,0.5,1.5,10,1600000059999,15,3,0,0,0\n1600000060000000,1,2,0.5,1.6,10,1600000119999,15,3,0,0,0\n")
    k = B.read_kline_zips(spark, str(tmp_path)).withColumn("ts", B.instant("open_time")).orderBy("ts").collect()
    assert len(k) == 2 and (k[1]["ts"] - k[0]["ts"]).seconds == 60
    info = spark.read.json(spark.sparkContext.parallelize(['{"symbols":[{"symbol":"A","filters":[{"filterType":"LOT_SIZE","stepSize":"0.1","minQty":"0.5"},{"filterType":"PRICE_FILTER","tickSize":"0.01"},{"filterType":"MIN_NOTIONAL","notional":"5"}]},{"symbol":"B","filters":[{"filterType":"PRICE_FILTER","tickSize":"1"}]}]}']))
    assert [tuple(x) for x in B.symbol_rules(info).collect()] == [("A", 0.5, 5.0, 0.01)]
    with pytest.raises(ValueError):
        B.bar_minutes("7m")


def test_ledger(spark, tmp_path):
    book = ledger.Ledger(str(tmp_path / "ledger"))
    for k in range(2):
        book.record("f", f"try{k}", {"k": k}, spark.createDataFrame([(day(i), 0.01 * ((i + k) % 3 - 1)) for i in range(40)], "date date, ret double"))
    book.record("f", "again", {"k": 0}, spark.createDataFrame([(day(i), 0.01) for i in range(40)], "date date, ret double"))
    assert book.verify() and len(book.trials()) == 2 and book.returns(spark).count() == 80
    text = book.lines.read_text()
    book.lines.write_text(text.replace("try1", "try9"))
    assert not book.verify()
    assert ledger.jsonable({"a": float("nan"), "b": {2, 1}}) == {"a": None, "b": [1, 2]}
    with pytest.raises(ValueError):
        ledger.jsonable({1: 0, "1": 1})


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("A", start + dt.timedelta(minutes=i), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, 1.0) for i in range(23)]
    minutes = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    minutes.write.parquet(str(tmp_path / "in"))
    stream = closed_bars(spark.readStream.schema(minutes.schema).parquet(str(tmp_path / "in")), "5m", "0 minutes")
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    batch = B.drop_partial(B.aggregate_bars(minutes, "5m"), minutes)
    assert sorted(map(tuple, spark.table("closed").collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 4


def test_pbo_tries_all_splits_of_sixteen_blocks(spark):
    R = np.random.default_rng(4).normal(0, 0.01, (160, 5))
    df = spark.createDataFrame([(k, t, float(R[t, k])) for t in range(160) for k in range(5)], "trial int, t int, ret double")
    x = R.reshape(16, 10, 5)
    bad = []
    for half in itertools.combinations(range(16), 8):
        a, o = x[list(half)].reshape(-1, 5), x[[k for k in range(16) if k not in half]].reshape(-1, 5)
        best, out = (a.mean(0) / a.std(0)).argmax(), o.mean(0) / o.std(0)
        bad.append((out <= out[best]).sum() / 6 <= 0.5)
    assert len(bad) == 12870 and stats.pbo(df) == pytest.approx(np.mean(bad))


def fills(at, buy, sell, cap, capital=None, price=None, lot=1.0, least=0.0):
    """The rules of a fill day by day, in plain loops."""
    out, prev = [], [0.0] * at.shape[1]
    for t in range(len(at)):
        def day(k):
            want, new = [], []
            for j, x in enumerate(at[t] * k):
                if capital is not None and x != 0:
                    x = np.round(x * capital / price[t, j] / lot) * lot * price[t, j] / capital if np.isfinite(price[t, j]) else prev[j]
                d = x - prev[j]
                stuck = d > 0 and not buy[t, j] or d < 0 and not sell[t, j] or capital is not None and d != 0 and abs(d) * capital < least
                want.append(x)
                new.append(prev[j] if stuck else x)
            return want, new

        want, new = day(1.0)
        room = sum(map(abs, want)) + 1e-12
        if cap and sum(map(abs, new)) > room:
            k = 0.0
            if sum(map(abs, day(0.0)[1])) <= room:
                k = max(k for k in np.linspace(0, 1, 4001) if sum(map(abs, day(k)[1])) <= room)
            new = day(k)[1]
        out.append(prev := new)
    return np.array(out)


@pytest.mark.parametrize(("cap", "lots"), [(False, False), (False, True), (True, False)])
def test_fills_equal_loops(spark, cap, lots):
    r = np.random.default_rng(5)
    T, N = 30, 6
    at = r.normal(0, 0.3, (T, N)).round(2) * (r.random((T, N)) > 0.2)
    buy, sell, price = r.random((T, N)) > 0.25, r.random((T, N)) > 0.25, r.uniform(5, 50, (T, N))
    price[r.random((T, N)) < 0.1] = np.nan
    rows = [(t, f"N{j}", float(at[t, j]), bool(buy[t, j]), bool(sell[t, j]), None if np.isnan(price[t, j]) else float(price[t, j]), 10.0) for t in range(T) for j in range(N)]
    df = spark.createDataFrame(rows, "t int, ticker string, w double, can_buy boolean, can_sell boolean, price double, lot double")
    money = {"capital": 1e4, "least_trade": 500.0} if lots else {}
    got = execution.realize(df, (), cap, **money)
    h = got.select("t", "ticker", "h").toPandas().pivot(index="t", columns="ticker", values="h").sort_index().to_numpy()
    want = fills(at, buy, sell, cap, 1e4 if lots else None, price, 10.0, 500.0)
    if not cap:
        assert np.allclose(h, want, atol=1e-12)
    else:  # the scale is searched on a grid there: the gross value keeps to the target's, and is not far below what the grid finds
        for t in range(T):
            assert np.abs(h[t]).sum() <= max(np.abs(at[t]).sum(), np.abs(np.where((h[t] == (h[t - 1] if t else 0)), h[t], 0)).sum()) + 1e-9
        assert np.allclose(h[0], want[0], atol=1e-3)
    s = execution.fill_statistics(got).first()
    stuck = got.where("blocked AND t > 0").count()
    assert s["blocked_trades"] == stuck > 0 and 0 < s["blocked_share"] < 1 and (s["mean_scale"] < 1) == cap


def test_suspensions_have_four_outcomes(spark):
    def bars(name, closes, volumes, last=None):
        return [(t, name, None if c is None else float(c), None if v is None else float(v), t == last) for t, (c, v) in enumerate(zip(closes, volumes))]

    rows = bars("resumed", [10.0] * 12, [1.0, 1, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1]) + bars("dead", [10.0] * 5 + [None] * 7, [1.0, 1, 0, None, 0] + [None] * 7, 4)
    rows += bars("liquidated", [10.0, 10, 10, 10, 10, 4, 3] + [None] * 5, [1.0, 1, 0, 0, 0, 1, 1] + [None] * 5, 6) + bars("open", [10.0] * 12, [1.0] * 9 + [0.0] * 3)
    rows += bars("first", [5.0] * 4 + [6.0] * 8, [0.0] * 4 + [1.0] * 8) + bars("short", [5.0] * 12, [1.0, 0, 0] + [1.0] * 9)
    df = spark.createDataFrame(rows, "t int, ticker string, close double, volume double, delist_after boolean")
    got = {x["ticker"]: (x["start_t"], x["end_t"], x["outcome"], x["ret"]) for x in execution.freeze_episodes(df, 3, 5).collect()}
    assert got == {"resumed": (2, 4, "resumed", 0.0), "dead": (2, 4, "ended_in_halt", 0.0), "liquidated": (2, 4, "resumed_then_delisted", 3 / 10 - 1), "open": (9, 11, "ongoing", None), "first": (0, 3, "resumed", None)}
    m = {(x["ticker"], x["t"]): (x["can_buy"], x["can_sell"]) for x in execution.tradability(df, max_gap=3).collect()}
    assert m["dead", 3] == (False, False) and m["dead", 4] == (False, False) and m["dead", 5] == (True, True)  # unknown volume halts; after the last bar a position can be closed
    gap = spark.createDataFrame([(t, "A", 1.0 if t < 3 or t > 8 else None, 1.0) for t in range(12)], "t int, ticker string, close double, volume double")
    assert [x["can_sell"] for x in execution.tradability(gap, max_gap=3).orderBy("t").collect()] == [True] * 3 + [False] * 3 + [True] * 6
    move = spark.createDataFrame([(t, "A", c, 1.0) for t, c in enumerate([100.0, 129.0, 128.0, 91.0])], "t int, ticker string, close double, volume double")
    got = [(x["can_buy"], x["can_sell"]) for x in execution.tradability(move, limit=0.3).orderBy("t").collect()]
    assert got == [(True, True), (False, True), (True, True), (True, True)]
    with pytest.raises(ValueError):
        execution.tradability(move, limit=0.3, tol=0.4)


def test_engine_arguments(spark, p):
    f = recipes.reversal(4)
    base = engine.backtest_portfolio(p, f, long_q=0.25, short_q=0.25, hold=3, spread_bp=20.0, benchmark="equal", grid=False)
    old = portfolio.backtest_portfolio(p, "factor", long_q=0.25, short_q=0.25, hold=3, spread_bp=20.0, df=portfolio.one_bar(p).withColumn("factor", f)).orderBy("t").toPandas()
    assert np.allclose(base.daily.orderBy("t").toPandas()["net"], old["net"], atol=1e-12)
    same = p.df.select("date", "ticker", F.lit(10.0).alias("value"))
    panel = engine.backtest_portfolio(p, f, long_q=0.25, short_q=0.25, hold=3, spread_bp=same, grid=False, benchmark=None)  # a panel is one way: half of the round trip
    assert np.allclose(panel.daily.orderBy("t").toPandas()["net"], old["net"], atol=1e-12)
    late = spark.createDataFrame([(day(5), 3.0)], "effective_date date, value double")
    with pytest.raises(ValueError, match="unknown"):
        engine.backtest_portfolio(p, f, buy_bp=late, grid=False)
    hole = p.df.select("date", "ticker", F.when(F.col("t") % 2 == 0, 5.0).alias("value"))
    with pytest.raises(ValueError, match="short is held"):
        engine.backtest_portfolio(p, f, borrow_bp=hole, grid=False, long_q=0.25, short_q=0.25)
    for bad in ({"sell_bp": -1.0}, {"weighting": "other"}, {"benchmark": "other"}, {"freeze_days": 2, "freeze_return": 0.1}, {"freeze_days": 0}, {"hold": 0}):
        with pytest.raises(ValueError):
            engine.backtest_portfolio(p, f, grid=False, **bad)
    g = engine.backtest_portfolio(p, f, long_q=0.25, short_q=0.25, hold=3, spread_bp=20.0).grid
    one = g.where("hold = 5 AND cost_bp = 20.0").orderBy("t").toPandas()["net"]
    assert np.allclose(one, engine.backtest_portfolio(p, f, long_q=0.25, short_q=0.25, hold=5, spread_bp=20.0, grid=False).daily.orderBy("t").toPandas()["net"], atol=1e-12)
    masked = p.with_df(execution.tradability(p.df, max_gap=None))
    run = engine.backtest_portfolio(masked, f, long_q=0.25, short_q=0.25, hold=3, cap_gross=True)
    m = run.metrics()
    assert m["blocked_trades"] > 0 and m["mean_scale"] < 1 and run.positions.groupBy("t").agg(F.sum(F.abs("h")).alias("g")).agg(F.max("g")).first()[0] < 3


def test_weights_engine(spark, p):
    w = p.df.where("eligible AND close IS NOT NULL").select("date", "ticker", (F.when(F.col("ticker") < "N06", 0.1).otherwise(-0.05)).alias("w"))
    h = wide(joins.align(p.df, w), "w").fillna(0).to_numpy()
    close = wide(p.df, "close")
    fwd = (close / close.shift(1) - 1).shift(-2).fillna(0).to_numpy()
    d = np.vstack([np.zeros(h.shape[1]), np.diff(h, axis=0)])
    want = (h * fwd).sum(1) - np.abs(d).sum(1) * 8 / 2e4 - (np.maximum(d, 0) * 2 + np.maximum(-d, 0) * 20).sum(1) / 1e4 - np.maximum(-h, 0).sum(1) * 100 / 1e4 / 365
    run = engine.backtest_weights(p, w, spread_bp=8.0, buy_bp=2.0, sell_bp=20.0, borrow_bp=100.0)
    assert np.allclose(run.daily.orderBy("t").toPandas()["net"], want[:-2], atol=1e-12)
    with pytest.raises(ValueError, match="not eligible"):
        engine.backtest_weights(p, p.df.select("date", "ticker", F.lit(0.1).alias("w")))
    banned = p.with_df(p.df.withColumn("shortable", F.lit(False)))
    with pytest.raises(ValueError, match="short"):
        engine.backtest_weights(banned, w)
    with pytest.raises(ValueError, match="capital"):
        engine.backtest_weights(p, w, min_trade_value=5.0)
    price = p.df.select("date", "ticker", F.col("close").alias("value"))
    lots = engine.backtest_weights(p, w, capital=1e5, price=price, lot=10.0)
    x = lots.positions.join(p.df.select("t", "ticker", F.lead("close", 1).over(C.by_time()).alias("px")), ["t", "ticker"]).where("h <> 0 AND px IS NOT NULL").withColumn("s", F.col("h") * 1e5 / F.col("px") / 10)
    assert x.where("abs(s - round(s)) < 1e-6").count() > 0.8 * x.count() and lots.figures["skipped_trades"] == 0


def test_more_inference(spark):
    r = np.random.default_rng(7)
    x, y = r.normal(0.001, 0.01, 400), r.normal(0.0, 0.01, 400)
    f = lambda v: spark.createDataFrame([(t, day(t), float(z)) for t, z in enumerate(v)], "t int, date date, net double")
    d = stats.sharpe_diff_ci(f(y), f(y + 0.002), 252, 200)
    assert d["lo"] > 0 and d["p"] < 0.05 and stats.sharpe_diff_ci(f(x), f(x), 252, 200)["diff"] == 0
    q = stats.drawdown_distribution(f(x), 200)
    e = np.cumprod(1 + x)
    assert q["realized"] == pytest.approx((e / np.maximum(np.maximum.accumulate(e), 1) - 1).min()) and q["p05"] < q["p50"] < q["p95"] < 0
    io = stats.in_out_of_sample(f(x), day(200), 252)
    assert io["mean_diff_t"] == pytest.approx((x[200:].mean() - x[:200].mean()) / math.sqrt(x[:200].var(ddof=1) / 200 + x[200:].var(ddof=1) / 200)) and io["in_sample"]["bars"] == 200
    var = [x[:20].var(ddof=1)]
    for v in x:
        var.append(0.94 * var[-1] + 0.06 * v * v)
    assert stats.filtered_risk(f(x))["var_95_now"] == pytest.approx(math.sqrt(var[-1]) * np.percentile(x / np.sqrt(var[:-1]), 5))
    m = stats.mean_report(f(x), 252)
    assert m["win_rate"] == pytest.approx((x > 0).mean()) and m["win_lo"] < m["win_rate"] < m["win_hi"] and m["sharpe"] == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252))
    dd = stats.drawdown_dates(f([0.1, -0.2, 0.05, 0.3, -0.1])).first()
    assert (dd["peak_t"], dd["trough_t"], dd["recovery_t"]) == (0, 1, 3)
    frame = pd.DataFrame({"y": 0.5 * x + y, "a": x, "b": r.normal(size=400)})
    o = stats.decompose(frame, "y", ["a", "b"])
    assert o["alpha_annual"] + sum(o["contribution_annual"].values()) == pytest.approx(frame["y"].mean() * 252) and 0 < o["unexplained_share"] < 1
    with pytest.raises(ValueError):
        stats.decompose(frame.assign(c=1.0), "y", ["a", "c"])


@pytest.mark.parametrize("method, weighting, short_q, hold", [("labels", "equal", 0.25, 3), ("labels", "signal", None, 20), ("daily", "rank", 0.25, 3), ("daily", "equal", 0.25, 1)])
def test_permutation_replicates(spark, p, method, weighting, short_q, hold):
    n, q = 10, 0.25
    x = portfolio.one_bar(p).withColumn("f", F.round(recipes.reversal(4), 2))
    f, ok, r = wide(x, "f"), wide(x, "eligible") == 1, wide(x, "fwd1")
    k = x.select("t", "ticker").crossJoin(spark.range(n))
    k = k.withColumn("h", F.xxhash64(F.lit(5), "id", "ticker") if method == "labels" else F.xxhash64(F.lit(5), "id", "t", "ticker")).toPandas()
    want = {}
    for rep in range(-1, n):
        g = f.copy()
        for t in f.index if rep >= 0 else ():
            pool = f.columns if method == "labels" else f.columns[ok.loc[t] & f.loc[t].notna()]
            h = k[(k["id"] == rep) & (k["t"] == t)].set_index("ticker")["h"].loc[pool].sort_values()
            if method == "labels":
                g.loc[t, h.index] = f.loc[t, pool].to_numpy()
            else:
                g.loc[t] = np.nan
                g.loc[t, pool] = f.loc[t, h.index].to_numpy()
        rank = g.where(ok).rank(axis=1, pct=True)
        part = lambda inside, far, g=g: inside * {"equal": 1.0, "rank": far, "signal": g.abs()}[weighting]
        w = [part(rank >= 1 - q, rank - (1 - q))] + ([part(rank <= short_q, short_q - rank)] if short_q else [])
        w = [x.fillna(0.0).div(x.sum(axis=1).replace(0, np.nan), axis=0).fillna(0.0) for x in w]
        held = (w[0] - (w[1] if short_q else 0)).rolling(hold, 1).sum().div(np.minimum(hold, np.arange(len(f)) + 1), axis=0)
        net = (held * r).sum(axis=1).iloc[: -1 - p.entry_lag]
        want[rep] = net.mean() / net.std() * math.sqrt(p.periods_per_year)
    got = {x["rep"]: x["sharpe"] for x in sweeps.factor_permutation(p, F.round(recipes.reversal(4), 2), n, method, 5, long_q=q, short_q=short_q, hold=hold, weighting=weighting).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("method", ["labels", "daily"])
def test_permutation_makes_no_rows_of_replicates_and_names(p, method):
    plan = sweeps.factor_permutation(p, recipes.reversal(4), 10, method, hold=3)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not [x for x in dealt if "rep#" in x and "ticker#" in x]


def test_bars_are_dealt_once(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = base.panel(session, "/root/testdata/sf0.001").df.select("t", "ticker", "close")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert len([k for k in dealt if "," in k]) == 2  # the sums of the bars, and the spine


def test_hashes_of_names_are_spark_s(spark):
    names = [("é" * (i % 5) + "abcdefghij" * (i % 9))[:i] + str(i) for i in range(90)] + [""]
    for seed, width in ((-3, 4), (1 << 40, 8)):
        h = spark.createDataFrame(list(enumerate(names)), "i int, x string").select("i", F.xxhash64(F.lit(seed), F.lit(7).cast("long"), F.lit(11), "x").alias("h"))
        assert draws.Keys(names).hashed((seed, width), (7, 8), (11, 4)).tolist() == [x["h"] for x in h.orderBy("i").collect()]


def test_permutations_and_lookahead(p):
    known = F.lead("close", 2).over(C.by_time()) / F.lead("close", 1).over(C.by_time())
    for method in ("labels", "daily"):
        s = sweeps.null_summary(sweeps.factor_permutation(p, known, 19, method, long_q=0.25, short_q=0.25, hold=1))
        assert s["p"] == 0.05 and s["real"] > s["null_p99"]
    rep = sweeps.factor_permutation(p, recipes.reversal(4), 10, long_q=0.25, short_q=0.25, hold=3).where("rep = -1").first()["sharpe"]
    net = engine.backtest_portfolio(p, recipes.reversal(4), long_q=0.25, short_q=0.25, hold=3, spread_bp=0.0, benchmark=None, grid=False).daily.toPandas()["net"]
    assert rep == pytest.approx(net.mean() / net.std() * math.sqrt(365))
    up = F.lead("close", 3).over(C.by_time()) / F.lead("close", 1).over(C.by_time()) > 1.03
    for method in ("shift", "random_picks"):
        s = sweeps.null_summary(sweeps.signal_permutation(p, up, 2, 10.0, n=20, method=method, min_shift=5), "win")
        assert s["real"] > 0.9 and s["p"] < 0.06
    look = sweeps.assert_no_lookahead(p, F.col("close"), 3, 4)
    assert set(look) == {"base_bp", "lagged_bp", "tol_bp", "pass"}
