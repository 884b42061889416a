"""Portfolio engines: a factor or given weights to the daily result, with every cost, and its figures.

All that a day needs is one aggregate over the positions: each sleeve (the long
and the short leg, or the net weights) contributes its return, trades, fees and
marks. Rates are numbers, dated schedules or panels; dated ones are read on the
execution day. An unknown rate raises; it is never zero.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import columns as C
from . import costs, execution, joins, portfolio
from .panel import Panel, check_alignment, ret

Rate = float | DataFrame | None
HOLDS, COSTS = (1, 2, 5, 10, 21), (0.0, 2.0, 5.0, 10.0, 20.0)


def rate_input(p: Panel, df: DataFrame, value: Rate, name: str, unknown: bool = False) -> DataFrame:
    """df with column `name`, the rate in force on the execution day. value: a number, dated values (date or effective_date, value) or a panel (date, ticker, value). Unknown values raise unless `unknown`."""
    if value is None or not isinstance(value, DataFrame):
        x = 0.0 if value is None else float(value)
        if not 0 <= x < float("inf"):
            raise ValueError(f"{name} must be finite and not negative, got {value!r}")
        return df.withColumn(name, F.lit(x))
    lag = p.entry_lag
    if "ticker" in value.columns:
        at = joins.align(p.df.select("t", "date", "ticker"), value.select("date", "ticker", F.col("value").cast("double").alias("_v")))
        w = C.by_time()
        end = F.last("_v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        at = at.withColumn("_e", F.max("t").over(Window.partitionBy())).select("t", "ticker", "_v", F.when(F.col("t") + lag <= F.col("_e"), F.lead("_v", lag).over(w) if lag else F.col("_v")).otherwise(end).alias(name))
        keys = ["t", "ticker"]
    else:
        day = "effective_date" if "effective_date" in value.columns else "date"
        days = joins.asof_backward(p.df.select("t", "date").distinct(), value.select(F.col(day).alias("date"), F.col("value").cast("double").alias("_v")), "date", (), ("_v",))
        at = days.select("t", "_v", (costs.at_execution("_v", lag) if lag else F.col("_v")).alias(name))
        keys = ["t"]
    bad, negative = at.agg(F.count_if(F.col("_v").isNull()), F.count_if((F.col("_v") < 0) | F.isnan("_v") | (F.col("_v") == float("inf")))).first()
    if bad and not unknown:
        raise ValueError(f"{name} is unknown for {bad} dates or cells; a missing cost is an error, not zero")
    if negative:
        raise ValueError(f"{name} must be finite and not negative")
    return df.join(at.drop("_v"), keys, "left")


def factor_on(p: Panel, factor: DataFrame | Column, name: str = "factor") -> DataFrame:
    """The panel's rows with the factor: a Column over them (ret1 is there), or rows (date, ticker, value)."""
    df = p.df.withColumn("ret1", ret(1))
    if isinstance(factor, Column):
        return df.withColumn(name, factor)
    if dict(factor.dtypes)["value"] == "boolean":
        raise ValueError("a yes/no factor is no ranking; test it as an event")
    check_alignment(p, factor, name)
    return joins.align(df, factor.select("date", "ticker", F.col("value").alias(name)))


@dataclass
class Run:
    """What an engine gives: positions (t, date, ticker, h), the daily table, and its figures."""

    panel: Panel
    spec: dict
    positions: DataFrame
    daily: DataFrame
    figures: dict = field(default_factory=dict)
    grid: DataFrame | None = None
    notes: list[str] = field(default_factory=list)

    @property
    def net(self) -> DataFrame:
        return self.daily.select("t", "date", "net")

    def metrics(self) -> dict:
        """Figures of the net returns, annual costs in basis points, and what the run counted."""
        k = self.panel.periods_per_year
        m = stats.metrics(self.daily, k).first().asDict()
        parts = ("cost", "spread", "side", "borrow", "funding", "impact", "mark")
        a = self.daily.agg(*(F.avg(c).alias(c) for c in (*parts, "turnover")), F.sum("delist_hits").alias("delist_events_held"), F.sum("marks").alias("freeze_events"), F.max(F.col("net") <= -1).alias("ruined"), F.avg(F.when(F.col("n_long") > 0, F.col("n_long"))).alias("avg_positions")).first().asDict()
        gross = stats.metrics(stats.stop_at_ruin(self.daily.select("t", "date", (F.col("gross") + F.col("mark")).alias("net"))), k).first()
        annual = {f"{c}_annual_bp": (a[c] or 0.0) * k * 1e4 for c in parts}
        return m | annual | {"turnover_daily": a["turnover"], "gross_cagr": gross["cagr"]} | {c: a[c] for c in ("delist_events_held", "freeze_events", "ruined", "avg_positions")} | self.figures

    def benchmark(self) -> dict | None:
        return None if self.spec["benchmark"] is None else stats.metrics(self.daily.select("t", "date", F.col("bench").alias("net")), self.panel.periods_per_year).first().asDict()

    def excess(self) -> dict | None:
        x = self.daily.select("t", "date", (F.col("net") - F.col("bench")).alias("net"))
        return None if self.spec["benchmark"] is None else stats.metrics(stats.stop_at_ruin(x), self.panel.periods_per_year).first().asDict()

    def yearly(self) -> DataFrame:
        return stats.period_returns(self.net, "year")

    def alpha_beta(self, factors: DataFrame, names: list[str]) -> dict:
        return stats.decompose(self.net.join(factors, "t").toPandas(), "net", names, periods=self.panel.periods_per_year)

    def sharpe_ci(self, n: int = 2000, seed: int = 0) -> dict:
        return stats.sharpe_ci(self.net, self.panel.periods_per_year, n, seed=seed)


def _benchmark(df: DataFrame, kind: str | None) -> DataFrame:
    w = F.when(F.col("mkt_cap") > 0, F.col("mkt_cap")) if kind == "cap" and "mkt_cap" in df.columns else F.lit(1.0)
    w = F.when(F.col("eligible"), F.coalesce(w, F.lit(0.0))).otherwise(0.0)
    return df.groupBy("t").agg(F.coalesce(C.div(F.sum(w * F.col("fwd1")), F.sum(w)), F.lit(0.0)).alias("bench"))


def simulate(
    p: Panel, held: DataFrame, sleeves: list[str], *, spread_bp: Rate = 0.0, buy_bp: Rate = 0.0, sell_bp: Rate = 0.0, borrow_bp: Rate = 0.0, freeze_days: int | None = None, freeze_return: float = 0.0,
    impact: costs.ImpactModel | None = None, benchmark: str | None = "cap",
) -> DataFrame:
    """The daily table: t, date, gross, spread, side, cost, borrow, funding, impact, mark, turnover, net, bench and counts, of `held`: the panel's rows with fwd1, fund1, hit1 (`portfolio.one_bar`) and signed weights in the columns `sleeves`."""
    if benchmark not in ("cap", "equal", None):
        raise ValueError(f"benchmark must be 'cap', 'equal' or None, not {benchmark!r}")
    freeze_return = execution.check_freeze_return(freeze_return)
    x = rate_input(p, rate_input(p, held, buy_bp, "_buy"), sell_bp, "_sell")
    x = rate_input(p, x, borrow_bp, "_fee", True)
    if isinstance(spread_bp, DataFrame):  # one way; unknown cells are the median
        x = joins.align(x, spread_bp.select("date", "ticker", F.col("value").alias("_s")))
        x = x.crossJoin(F.broadcast(x.agg(F.median("_s").alias("_m")))).withColumn("_way", F.coalesce("_s", "_m"))
    else:
        if spread_bp < 0 or spread_bp == float("inf"):
            raise ValueError("spread_bp must be finite and not negative")
        x = x.withColumn("_way", F.lit(float(spread_bp) / 2))
    x = execution.freeze_hits(x, freeze_days, p.entry_lag) if freeze_days is not None else x.withColumn("frozen", F.lit(False))
    w = C.by_time()
    for s in sleeves:
        x = x.withColumn(f"_d{s}", F.coalesce(F.col(s) - F.lag(s).over(w), F.lit(0.0)))
    zero, total = F.lit(0.0), lambda f: sum((f(F.col(s), F.col(f"_d{s}")) for s in sleeves), F.lit(0.0))
    book = total(lambda h, d: h)
    x = x.withColumn("_h", book).withColumn("_short", total(lambda h, d: F.greatest(-h, zero)))
    x = x.withColumn("_unknown", (F.col("_short") > 1e-12) & F.col("_fee").isNull())
    day = x.groupBy("t", "date").agg(
        F.sum(F.col("_h") * F.col("fwd1")).alias("gross"), F.sum(total(lambda h, d: F.abs(d)) * F.col("_way") / 1e4).alias("spread"),
        F.sum(total(lambda h, d: F.greatest(d, zero)) * F.col("_buy") / 1e4 + total(lambda h, d: F.greatest(-d, zero)) * F.col("_sell") / 1e4).alias("side"),
        F.sum(F.col("_short") * F.coalesce("_fee", zero) / 1e4 / p.periods_per_year).alias("borrow"), F.sum(F.col("_h") * F.col("fund1")).alias("funding"),
        F.sum(F.when(F.col("frozen"), total(lambda h, d: F.greatest(h, zero)) * freeze_return).otherwise(0.0)).alias("mark"), F.sum(total(lambda h, d: F.abs(d)) / 2).alias("turnover"),
        F.count_if(F.col("hit1") & total(lambda h, d: F.abs(h)).__gt__(0)).alias("delist_hits"), F.count_if(F.col("frozen") & total(lambda h, d: F.greatest(h, zero)).__gt__(0)).alias("marks"),
        F.count_if(F.col(sleeves[0]) > 0).alias("n_long"), F.count_if("_unknown").alias("unknown_fees"),
    )
    if isinstance(borrow_bp, DataFrame) and (n := day.agg(F.sum("unknown_fees")).first()[0]):
        raise ValueError(f"borrow_bp is unknown on {n} position-days on which a short is held")
    if impact is not None:
        moved = impact.cost(x.select("t", "ticker", "close", "volume", ret(1).alias("ret1")), x.select("t", "ticker", F.col("_h").alias("h"))).withColumnRenamed("cost", "impact")
        day = day.join(moved, "t", "left").withColumn("impact", F.coalesce("impact", zero))
    else:
        day = day.withColumn("impact", zero)
    day = day.join(_benchmark(x, benchmark), "t", "left")
    day = day.withColumn("cost", F.col("spread") + F.col("side")).withColumn("net", F.col("gross") + F.col("mark") - F.col("cost") - F.col("borrow") - F.col("funding") - F.col("impact"))
    day = day.withColumn("_e", F.max("t").over(Window.partitionBy())).where(F.col("t") < F.col("_e") - p.entry_lag).drop("_e", "unknown_fees")
    return stats.stop_at_ruin(day)


def _filled(p: Panel, df: DataFrame, column: str, sign: float, cap_gross: bool) -> DataFrame:
    """t, ticker and what `realize` gives for sign times a column of targets."""
    mask = execution.exec_masks(p.entry_lag)
    x = df.select("t", "ticker", (F.col(column) * sign).alias("w"), *((v if p.has(c) else F.lit(True)).alias(c) for c, v in mask.items()))
    return execution.realize(x, (), cap_gross)


def legs(p: Panel, df: DataFrame, long_q: float, short_q: float | None, weighting: str) -> DataFrame:
    """df (with factor) and wl, ws: the day's targets of both legs. The short leg is chosen among names that can be sold short on the execution day."""
    df = df.withColumn("_rl", C.pct_rank("factor", "eligible"))
    df = df.withColumn("wl", C.weights(portfolio.leg("_rl", "factor", long_q, True, weighting)))
    if short_q is None:
        return df.withColumn("ws", F.lit(0.0)).drop("_rl")
    if p.has("shortable"):
        df = df.withColumn("_se", F.col("eligible") & F.lead("shortable", p.entry_lag, True).over(C.by_time()))
        df = df.withColumn("_rs", C.pct_rank("factor", "_se")).drop("_se")
    else:
        df = df.withColumn("_rs", F.col("_rl"))
    return df.withColumn("ws", C.weights(portfolio.leg("_rs", "factor", short_q, False, weighting))).drop("_rl", "_rs")


def backtest_portfolio(
    p: Panel, factor: DataFrame | Column, *, long_q: float = 0.1, short_q: float | None = 0.1, hold: int = 5, weighting: str = "equal", spread_bp: Rate = 20.0, buy_bp: Rate = 0.0, sell_bp: Rate = 0.0, borrow_bp: Rate = 0.0,
    benchmark: str | None = "cap", grid: bool = True, funding: bool = True, delist_return: float | None = None, freeze_days: int | None = None, freeze_return: float = 0.0, cap_gross: bool = False,
    impact: costs.ImpactModel | None = None, ledger=None, family: str = "default", name: str | None = None,
) -> Run:
    """Factor to long/short book. A number as spread_bp is a round trip, a panel one way; buy_bp, sell_bp and borrow_bp as in `rate_input`; the legs are separate sleeves."""
    if weighting not in portfolio.WEIGHTINGS:
        raise ValueError(f"weighting must be one of {', '.join(portfolio.WEIGHTINGS)}")
    portfolio.check_arguments(long_q, short_q, hold)
    q, notes = p.with_df(portfolio.one_bar(p.with_df(factor_on(p, factor)), delist_return, funding)), []
    df = legs(p, q.df, long_q, short_q, weighting)
    df = df.withColumn("hl", portfolio.tranche("wl", hold)).withColumn("hs", -portfolio.tranche("ws", hold))
    figures, masked = {}, p.has("can_buy") or p.has("can_sell")
    if masked:
        sides = [("hl", 1.0), *([("hs", 1.0)] if short_q else [])]
        filled = [_filled(p, df, c, sign, cap_gross).withColumn("leg", F.lit(c)) for c, sign in sides]
        for (c, _), x in zip(sides, filled, strict=True):
            df = df.drop(c).join(x.select("t", "ticker", F.col("h").alias(c)), ["t", "ticker"], "left").withColumn(c, F.coalesce(c, F.lit(0.0)))
        both = filled[0] if len(filled) == 1 else filled[0].unionByName(filled[1])
        s = execution.fill_statistics(both, ("leg",)).agg(F.sum("blocked_trades").alias("blocked_trades"), F.sum("mean_stuck_weight").alias("mean_stuck_weight"), F.max("longest_freeze").alias("longest_freeze"), F.avg("mean_scale").alias("mean_scale"), F.sum("infeasible_days").alias("infeasible_days"), C.div(F.sum(F.col("blocked_share") * F.col("asked_turnover")), F.sum("asked_turnover")).alias("blocked_share"))
        figures = s.first().asDict()
    if short_q and not p.has("shortable"):
        notes.append("without `shortable` every security is taken to be borrowable on every day")
    daily = simulate(p, df, ["hl", "hs"], spread_bp=spread_bp, buy_bp=buy_bp, sell_bp=sell_bp, borrow_bp=borrow_bp, freeze_days=freeze_days, freeze_return=freeze_return, impact=impact, benchmark=benchmark)
    missing = execution.held_without_price(df, (F.col("hl") != 0) | (F.col("hs") != 0), p.entry_lag)
    spec = {"long_q": long_q, "short_q": short_q, "hold": hold, "weighting": weighting, "spread_bp": spread_bp if not isinstance(spread_bp, DataFrame) else "panel", "benchmark": benchmark, "entry_lag": p.entry_lag, "market": p.market, "periods_per_year": p.periods_per_year, "funding": bool(funding and p.has("funding")), "delist_return": delist_return, "freeze": None if freeze_days is None else [freeze_days, freeze_return]}
    run = Run(p, spec, df.select("t", "date", "ticker", (F.col("hl") + F.col("hs")).alias("h"), "fwd1", "eligible", *(c for c in ("mkt_cap", "volume", "close") if c in df.columns)), daily, figures, None, notes)
    n, t, ticker = missing.first()
    run.figures["held_missing_price"] = n
    if n:
        notes.append(f"{n} positions (first: {ticker} in row {t}) were held without a price to book their return: each earns 0")
    if grid and impact is None and not masked:
        run.grid = cost_grid(p, df, short_q, buy_bp, sell_bp, borrow_bp, freeze_days, freeze_return)
    if ledger is not None:
        ledger.record(family, name or "unnamed", spec, daily.select("date", F.col("net").alias("ret")))
    return run


def cost_grid(p: Panel, df: DataFrame, short_q: float | None, buy_bp: Rate = 0.0, sell_bp: Rate = 0.0, borrow_bp: Rate = 0.0, freeze_days: int | None = None, freeze_return: float = 0.0, holds=HOLDS, spreads=COSTS) -> DataFrame:
    """hold, cost_bp, t, date, net: all settings from one ranking. Holds are windows over the targets; round-trip spreads, being linear, are applied to the daily sums."""
    out = None
    for k in holds:
        x = df.withColumn("hl", portfolio.tranche("wl", k)).withColumn("hs", -portfolio.tranche("ws", k) if short_q else F.lit(0.0))
        day = simulate(p, x, ["hl", "hs"], spread_bp=0.0, buy_bp=buy_bp, sell_bp=sell_bp, borrow_bp=borrow_bp, freeze_days=freeze_days, freeze_return=freeze_return, benchmark=None).select(F.lit(k).alias("hold"), "t", "date", "net", "turnover")
        out = day if out is None else out.unionByName(day)
    return out.select("hold", F.explode(F.array(*map(F.lit, spreads))).alias("cost_bp"), "t", "date", "net", "turnover").withColumn("net", F.col("net") - F.col("turnover") * F.col("cost_bp") / 1e4).drop("turnover")


def backtest_weights(
    p: Panel, weights: DataFrame, *, spread_bp: Rate = 0.0, buy_bp: Rate = 0.0, sell_bp: Rate = 0.0, borrow_bp: Rate = 0.0, impact: costs.ImpactModel | None = None, funding: bool = True, delist_return: float | None = None, benchmark: str | None = "cap",
    check_universe: bool = True, check_shortable: bool = True, capital: float | None = None, price: DataFrame | None = None, lot: float | DataFrame = 1.0, min_trade_value: float = 0.0, freeze_days: int | None = None, freeze_return: float = 0.0,
    cap_gross: bool = False, ledger=None, family: str = "default", name: str | None = None,
) -> Run:
    """Given weights (date, ticker, w; unknown is 0), costs on the net trade of each security. Positions opened or increased outside the universe, or short where that is not possible on the execution day, raise. price: (date, ticker, value), the real level on the day of the trade; lot: a number or (ticker, value)."""
    if capital is None and (price is not None or min_trade_value or isinstance(lot, DataFrame) or lot != 1.0):
        raise ValueError("price, lot and min_trade_value need capital")
    if capital is not None and (not 0 < capital < float("inf") or price is None):
        raise ValueError("capital must be positive and needs the real price")
    check_alignment(p, weights, "weights")
    x = joins.align(portfolio.one_bar(p.with_df(p.df.withColumn("ret1", ret(1))), delist_return, funding), weights.select("date", "ticker", F.col("w").cast("double").alias("h")))
    infinite, nan = x.agg(F.count_if(F.abs("h") == float("inf")), F.count_if(F.col("h").isNull() | F.isnan("h"))).first()
    if infinite:
        raise ValueError("weights contain infinite values")
    x = x.withColumn("h", F.when(F.col("h").isNotNull() & ~F.isnan("h"), F.col("h")).otherwise(0.0))
    before = F.coalesce(F.lag("h").over(C.by_time()), F.lit(0.0))
    zero = F.lit(0.0)
    x = x.withColumn("_long", F.greatest("h", zero) > F.greatest(before, zero) + 1e-12).withColumn("_short", F.greatest(-F.col("h"), zero) > F.greatest(-before, zero) + 1e-12)
    can = F.lead("shortable", p.entry_lag, True).over(C.by_time()) if p.has("shortable") and check_shortable else F.lit(True)
    x = x.withColumn("_can", can)
    outside, banned, first = x.agg(F.count_if((F.col("_long") | F.col("_short")) & ~F.col("eligible")), F.count_if(F.col("_short") & ~F.col("_can")), F.min(F.when((F.col("_long") | F.col("_short")) & ~F.col("eligible") | F.col("_short") & ~F.col("_can"), F.struct("date", "ticker")))).first()
    if check_universe and outside:
        raise ValueError(f"{outside} positions are opened or increased in names that are not eligible (first: {first['ticker']} on {first['date']})")
    if banned:
        raise ValueError(f"{banned} short positions are opened or increased where that is not possible (first: {first['ticker']} on {first['date']})")
    x, figures = x.drop("_long", "_short", "_can"), {"unknown_weights": nan}
    if capital is not None or p.has("can_buy") or p.has("can_sell"):
        mask = execution.exec_masks(p.entry_lag)
        y = x.select("t", "date", "ticker", F.col("h").alias("w"), *((v if p.has(c) else F.lit(True)).alias(c) for c, v in mask.items()))
        if capital is not None:
            y = joins.align(y, price.select("date", "ticker", F.col("value").alias("_p"))).withColumn("price", F.lead("_p", p.entry_lag).over(C.by_time()) if p.entry_lag else F.col("_p")).drop("_p")
            y = y.join(lot.select("ticker", F.col("value").cast("double").alias("lot")), "ticker", "left") if isinstance(lot, DataFrame) else y.withColumn("lot", F.lit(float(lot)))
        filled = execution.realize(y, (), cap_gross, capital=capital, least_trade=min_trade_value)
        figures |= execution.fill_statistics(filled).first().asDict()
        x = x.drop("h").join(filled.select("t", "ticker", "h"), ["t", "ticker"], "left").withColumn("h", F.coalesce("h", zero))
    daily = simulate(p, x, ["h"], spread_bp=spread_bp, buy_bp=buy_bp, sell_bp=sell_bp, borrow_bp=borrow_bp, freeze_days=freeze_days, freeze_return=freeze_return, impact=impact, benchmark=benchmark)
    figures["held_missing_price"] = execution.held_without_price(x, F.col("h") != 0, p.entry_lag).first()["n"]
    spec = {"kind": "weights", "spread_bp": spread_bp if not isinstance(spread_bp, DataFrame) else "panel", "benchmark": benchmark, "entry_lag": p.entry_lag, "market": p.market, "periods_per_year": p.periods_per_year, "funding": bool(funding and p.has("funding")), "delist_return": delist_return, "capital": capital, "freeze": None if freeze_days is None else [freeze_days, freeze_return]}
    run = Run(p, spec, x.select("t", "date", "ticker", "h", "fwd1", "eligible", *(c for c in ("mkt_cap", "volume", "close") if c in x.columns)), daily, figures)
    if ledger is not None:
        ledger.record(family, name or "weights", spec, daily.select("date", F.col("net").alias("ret")))
    return run


def backtest_intraday(p: Panel, factor: DataFrame | Column, *, one_way_bp: float = 0.0, long_q: float = 0.2, short_q: float | None = 0.2, hold: int = 1, benchmark: str | None = None, grid: bool = False, **settings) -> Run:
    """`backtest_portfolio` with a one-way cost, by default without grid and benchmark; entry at the signal's own bar is refused."""
    if p.entry_lag < 1:
        raise ValueError("intraday signals need an entry lag of at least one bar")
    return backtest_portfolio(p, factor, spread_bp=2 * one_way_bp, long_q=long_q, short_q=short_q, hold=hold, benchmark=benchmark, grid=grid, **settings)


def align_benchmark(p: Panel, daily: DataFrame) -> DataFrame:
    """t, bench: daily index returns (date, ret) moved back to the signal date, lag + 1 rows; NULL where the index has none."""
    days = p.df.select("t", "date").distinct().join(daily.select("date", F.col("ret").alias("_r")), "date", "left")
    return days.select("t", F.lead("_r", p.entry_lag + 1).over(Window.orderBy("t")).alias("bench"))


def warn_notes(run: Run) -> None:
    for x in run.notes:
        warnings.warn(x, stacklevel=2)
