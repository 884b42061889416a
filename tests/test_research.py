import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import columns as C
from tidemark.operators import portfolio, recipes, sweeps
from tidemark.plans import base, research

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def p(spark):
    q = base.panel(spark, SF)
    return q.with_df(q.df.cache())


def test_timing(p):
    sweeps.assert_timing(p)


def test_screen_finds_a_planted_factor(p):
    planted = F.lead("close", 5).over(C.by_time())
    out = research.screen(p, {"planted": planted, "noise": F.pmod(F.xxhash64("t", "ticker"), F.lit(1000)).cast("double")}, horizon=4, n_null=3, controls=["c_rev1", "c_logsize"])
    rows = {r["factor"]: r for r in out.tables["summary"]}
    assert rows["planted"]["ic"] > 0.2 and rows["planted"]["null_p95"] > 0
    assert rows["planted"]["ic"] > abs(rows["noise"]["ic"])
    assert json.loads(out.to_json())["numbers"]["factors"] == 2


def test_event(p):
    out = research.backtest_event(p, F.lead("ret1", 3).over(C.by_time()) > 0.3, horizons=(2,), cost_bp=0.0)
    assert out.numbers["t"] > 2.5 and out.tables["horizons"][0]["lift"] > 0.05 and out.tables["neutral"][0]["horizon"] == 2
    assert {g["gate"][:2] for g in out.tables["gates"]} == {"G1", "G2", "G3", "G4", "G5", "G6"}
    with pytest.raises(ValueError):
        research.backtest_event(p, F.lit(False), horizons=(4,))


def test_review_event(p, tmp_path):
    out = research.review_event(p, F.col("ret1") < -0.2, horizons=(1, 4), n_permutations=20)
    d = json.loads(out.to_json())
    assert 0 < d["numbers"]["permutation_p_win"] <= 1 and len(d["tables"]["costs"]) == 6 and d["numbers"]["longest_losing_streak_days"] >= 0
    wins = [r["win"] for r in d["tables"]["costs"]]
    assert wins == sorted(wins, reverse=True) and all(r["win_lo"] <= r["win"] <= r["win_hi"] for r in d["tables"]["horizons"] + d["tables"]["years"])
    assert any(x.startswith("event excess") for x in d["notes"])
    out.report(str(tmp_path / "event.html"))


def test_review_and_report(p, tmp_path):
    out = research.review_portfolio(p, recipes.reversal(5), n_bootstrap=50, n_permutations=10, make_factor=lambda n: recipes.reversal(n), grid={"n": [10, 2]}, walk=(104, 26))
    d = json.loads(out.to_json())
    assert d["numbers"]["sharpe_lo"] < d["numbers"]["sharpe_hi"] and len(d["tables"]["grid"]) == 9 and 0 < d["numbers"]["permutation_p"] <= 1
    assert 0 <= d["numbers"]["pbo"] <= 1 and "walk_oos_sharpe" in d["numbers"] and len(d["notes"]) >= 12
    assert len(json.loads(out.to_json("none"))["tables"]) < len(d["tables"])
    out.report(str(tmp_path / "page.html"))
    assert "<svg" in (tmp_path / "page.html").read_text()


def test_sweeps(p, spark):
    df = portfolio.one_bar(p).withColumn("factor", recipes.reversal(5))
    h = portfolio.holdings(p, "factor", 0.2, 0.2, 4, df=df).select("t", "ticker", (F.col("hl") - F.col("hs")).alias("h"))
    c = {x["aum"]: x["cost"] for x in sweeps.capacity_curve(p, h, [1e4, 1e6]).collect()}
    assert c[1e4] <= c[1e6]
    q = sweeps.participation(p.df, h, 1e5).first()
    assert q["p50"] <= q["p95"] <= q["p99"]
    lag = sweeps.latency_sweep(p, recipes.reversal(5), (1, 2)).groupBy("lag").count().collect()
    assert {x["lag"]: x["count"] for x in lag} == {1: 355, 2: 354}
    m = sweeps.style_returns(p)
    assert m.columns == ["t", "market", "illiquidity", "lowvol", "momentum", "reversal", "size"] and m.count() == 355
    hurt = sweeps.inject_delistings(p, 0.2, seed=3)
    n = hurt.df.where("delist_after").select("ticker").distinct().count()
    assert 20 < n < 100 and hurt.df.where("close IS NOT NULL").count() < p.df.where("close IS NOT NULL").count()
    with pytest.raises(ValueError):
        sweeps.inject_delistings(p, 1.5)
    s = sweeps.within_date_shuffle(p.df, "close", 2)
    a = s.groupBy("rep", "t").agg(F.round(F.sum("value"), 4).alias("s")).groupBy("t").agg(F.countDistinct("s").alias("k")).agg(F.max("k")).first()[0]
    assert a == 1
    scen = sweeps.survivorship_scenarios(p, lambda x, d: float(x.df.where("eligible").count()), rates=(0.1,), delist_returns=(-0.3,), n=2)
    assert scen[0]["mean"] < scen[0]["baseline"]


def test_compare(p):
    df = portfolio.one_bar(p).withColumn("factor", recipes.reversal(5))
    a, b = (portfolio.backtest_portfolio(p, "factor", hold=k, df=df) for k in (1, 8))
    out = research.compare({"a": a, "b": b}, 52).to_dict()
    assert [r["name"] for r in out["tables"]["metrics"]] == ["a", "b"] and -1 <= out["tables"]["correlation"][0]["corr"] <= 1
    with pytest.raises(ValueError):
        research.compare({"a": a}, 52)
    assert stats.sharpe_of is not None
