"""Quantile portfolios: legs, overlapping holdings, costs, and the daily result of each setting in one keyed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import columns as C
from .panel import Panel, ret


WEIGHTINGS = ("equal", "signal", "rank")


def check_arguments(long_q: float, short_q: float | None, hold: int, *costs: float) -> None:
    if not 0 < long_q <= 1 or short_q is not None and (not 0 < short_q <= 1 or long_q + short_q > 1):
        raise ValueError("the legs must be within 1 and not overlap")
    if hold < 1 or any(c < 0 for c in costs):
        raise ValueError("hold must be at least 1 and costs not negative")


def leg(rank: str | Column, signal: str, q: float, top: bool, weighting: str = "equal") -> Column:
    """Raw weights of a leg before normalisation: names with rank >= 1 - q, or <= q."""
    rank = C.col(rank)
    inside = rank >= F.lit(1 - q) if top else rank <= F.lit(q)
    far = rank - F.lit(1 - q) if top else F.lit(q) - rank
    size = {"equal": F.lit(1.0), "rank": far, "signal": F.abs(F.coalesce(F.col(signal), F.lit(0.0)))}[weighting]
    return F.when(inside, size).otherwise(0.0)


def tranche(w: str | Column, hold: int, t: str = "t") -> Column:
    """Mean of the last `hold` targets; in the first rows, of as many as there are."""
    return F.sum(C.col(w)).over(C.back(hold)) / F.least(F.lit(hold), F.col(t) + 1)


def one_bar(p: Panel, delist_return: float | None = None, funding: bool = True) -> DataFrame:
    """df with fwd1, fund1, hit1: the return of the bar after entry (missing as 0; 0 past the end; delist_return on the bar after a flagged last one), the funding rate over it, and whether it is that bar."""
    w, k = C.by_time(), p.entry_lag + 1
    gone = F.coalesce(F.lag("delist_after").over(w), F.lit(False)) if p.has("delist_after") else F.lit(False)
    r = F.coalesce(ret(1), F.lit(0.0))
    df = p.df.withColumn("_n", gone).withColumn("_r", r if delist_return is None else F.when(gone, float(delist_return)).otherwise(r))
    df = df.withColumn("fwd1", F.coalesce(F.lead("_r", k).over(w), F.lit(0.0))).withColumn("hit1", F.coalesce(F.lead("_n", k).over(w), F.lit(False)))
    rate = F.coalesce(F.lead(F.coalesce("funding", F.lit(0.0)), k).over(w), F.lit(0.0)) if funding and p.has("funding") else F.lit(0.0)
    return df.withColumn("fund1", rate).drop("_r", "_n")


def holdings(p: Panel, factor: str, long_q: float, short_q: float | None, hold: int, weighting: str = "equal", df: DataFrame | None = None) -> DataFrame:
    """df with hl, hs (long and short sleeve, both positive), of a factor column."""
    check_arguments(long_q, short_q, hold)
    df = (one_bar(p) if df is None else df).withColumn("_rank", C.pct_rank(factor, "eligible"))
    df = df.withColumn("_wl", C.weights(leg("_rank", factor, long_q, True, weighting)))
    df = df.withColumn("_ws", C.weights(leg("_rank", factor, short_q, False, weighting)) if short_q else F.lit(0.0))
    return df.withColumn("hl", tranche("_wl", hold)).withColumn("hs", tranche("_ws", hold)).drop("_rank", "_wl", "_ws")


def daily(p: Panel, held: DataFrame, cost_bp: float, cut: bool = True) -> DataFrame:
    """t, gross, cost, turnover, net. Each sleeve pays half the round trip for each unit traded; the first row is not charged; the last lag + 1 rows are cut."""
    w = C.by_time()
    d = F.abs(F.coalesce(F.col("hl") - F.lag("hl").over(w), F.lit(0.0))) + F.abs(F.coalesce(F.col("hs") - F.lag("hs").over(w), F.lit(0.0)))
    out = held.withColumn("_d", d).groupBy("t", "date").agg(F.sum((F.col("hl") - F.col("hs")) * F.col("fwd1")).alias("gross"), F.sum("_d").alias("traded"))
    out = out.select("t", "date", "gross", (F.col("traded") * (cost_bp / 2 / 1e4)).alias("cost"), (F.col("traded") / 2).alias("turnover"))
    out = out.withColumn("net", F.col("gross") - F.col("cost"))
    if cut:
        end = F.max("t").over(Window.partitionBy())
        out = out.withColumn("_end", end).where(F.col("t") < F.col("_end") - p.entry_lag).drop("_end")
    return out


def backtest_portfolio(p: Panel, factor: str, *, long_q: float = 0.2, short_q: float | None = 0.2, hold: int = 5, spread_bp: float = 10.0, weighting: str = "equal", df: DataFrame | None = None) -> DataFrame:
    """The daily table of one setting; df: the panel's rows with the factor column and fwd1 (`one_bar`)."""
    check_arguments(long_q, short_q, hold, spread_bp)
    return daily(p, holdings(p, factor, long_q, short_q, hold, weighting, df), spread_bp)


def grid(p: Panel, factor: str, holds: tuple[int, ...], costs: tuple[float, ...], long_q: float, short_q: float | None, df: DataFrame) -> DataFrame:
    """hold, cost_bp, t, net. Targets are ranked once; holds are windows over them, and costs, being linear, are applied after the daily sums."""
    df = df.withColumn("_rank", C.pct_rank(factor, "eligible"))
    df = df.withColumn("_wl", C.weights(leg("_rank", factor, long_q, True))).withColumn("_ws", C.weights(leg("_rank", factor, short_q, False)) if short_q else F.lit(0.0))
    df = df.select("t", "ticker", "fwd1", *(tranche("_wl", k).alias(f"l{k}") for k in holds), *(tranche("_ws", k).alias(f"s{k}") for k in holds))
    move = lambda c: F.abs(F.coalesce(F.col(c) - F.lag(c).over(C.by_time()), F.lit(0.0)))
    rows = df.select("t", "ticker", "fwd1", *(F.struct(F.lit(k).alias("hold"), ((F.col(f"l{k}") - F.col(f"s{k}")) * F.col("fwd1")).alias("g"), (move(f"l{k}") + move(f"s{k}")).alias("d")).alias(f"x{k}") for k in holds))
    rows = rows.select("t", F.explode(F.array(*(f"x{k}" for k in holds))).alias("x")).groupBy("x.hold", "t").agg(F.sum("x.g").alias("g"), F.sum("x.d").alias("d"))
    end = df.agg(F.max("t").alias("_end"))
    rows = rows.crossJoin(F.broadcast(end)).where(F.col("t") < F.col("_end") - p.entry_lag)
    return rows.select("hold", "t", F.explode(F.array(*map(F.lit, costs))).alias("cost_bp"), "g", "d").select("hold", "cost_bp", "t", (F.col("g") - F.col("d") * F.col("cost_bp") / 2e4).alias("net"))


def benchmark(df: DataFrame, kind: str = "equal") -> DataFrame:
    """t, bench: mean of fwd1 over eligible names, equal or by mkt_cap."""
    w = F.lit(1.0) if kind == "equal" else F.coalesce(F.col("mkt_cap"), F.lit(0.0))
    return df.where("eligible").groupBy("t").agg(C.div(F.sum(w * F.col("fwd1")), F.sum(w)).alias("bench"))


def event_weights(fire: str, hold: int) -> Column:
    """Each day's fires share 1 / hold; lots add up over hold rows."""
    share = C.div(F.when(F.col(fire), 1.0).otherwise(0.0), F.sum(F.when(F.col(fire), 1.0).otherwise(0.0)).over(C.by_date())) / hold
    return share


def blend(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """t, ticker, h: weighted sum of holdings."""
    out = None
    for h, w in parts:
        x = h.select("t", "ticker", (F.col("h") * w).alias("h"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("t", "ticker").agg(F.sum("h").alias("h"))
