"""Yes/no signals: trade statistics with base rates, day-level excess, fire structure, gates, attribution of holdings."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import columns as C


def trade_stats(df: DataFrame, cost_bp: float = 0.0, least: int = 100, pool: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and the distribution of trades (t, ticker, fire, cum, eligible), net of a round-trip cost: n, win, base, lift, mean, median, quartiles, average win and loss, payoff, skew_warning; NULL below `least` trades.

    base is the share of winners among all eligible names of the day, weighted by the day's trades, over days with a pool of at least `pool` names.
    """
    x = df.where(F.col("eligible") & F.col("cum").isNotNull()).withColumn("_r", F.col("cum") - cost_bp / 1e4)
    r = F.col("_r")
    day = x.groupBy(*keys, "t").agg(F.count("*").alias("n"), F.avg((r > 0).cast("double")).alias("rate"), F.count_if("fire").alias("k"))
    base = day.where(F.col("n") >= pool).groupBy(*keys).agg(C.div(F.sum(F.col("k") * F.col("rate")), F.sum("k")).alias("base"))
    a = x.where("fire").groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((r > 0).cast("double")).alias("win"), F.avg(r).alias("mean"), F.percentile(r, 0.5).alias("median"), F.percentile(r, 0.25).alias("p25"), F.percentile(r, 0.75).alias("p75"),
        F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"),
    )
    a = a.join(base, list(keys), "left") if keys else a.crossJoin(base)
    enough = F.col("n") >= least
    names = {"win": F.col("win"), "base": F.col("base"), "lift": F.col("win") - F.col("base"), **{c: F.col(c) for c in ("mean", "median", "p25", "p75", "avg_win", "avg_loss")}, "payoff": C.div("avg_win", F.abs("avg_loss"))}
    return a.select(*keys, "n", *(F.when(enough, v).alias(k) for k, v in names.items()), (enough & (F.col("mean") > 0) & (F.col("median") < 0)).alias("skew_warning"))


def daily_excess(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, t, excess: mean of the fired names less that of the day's pool, which needs max(5, min(30, half the median number of eligible names)) names."""
    d = df.groupBy(*keys, "t").agg(F.count_if("eligible").alias("e"), *_pool())
    least = d.groupBy(*keys).agg(F.floor(F.greatest(F.lit(5.0), F.least(F.lit(30.0), F.percentile("e", 0.5) * 0.5))).alias("least"))
    d = d.join(F.broadcast(least), list(keys)) if keys else d.crossJoin(F.broadcast(least))
    return d.where("n >= least AND hit IS NOT NULL").select(*keys, "t", (F.col("hit") - F.col("pool")).alias("excess"))


def _pool() -> list:
    known = F.col("eligible") & F.col("cum").isNotNull()
    return [F.count_if(known).alias("n"), F.avg(F.when(known, F.col("cum"))).alias("pool"), F.avg(F.when(known & F.col("fire"), F.col("cum"))).alias("hit")]


def fire_structure(df: DataFrame, longest_of: int = 30) -> DataFrame:
    """One row: fires, fires_per_day (of active days), active (share of days), names, top10 (share of the ten most frequent names), max_name_share (days of the most frequent name over all days), max_consecutive (longest run of any of the `longest_of` most frequent names), daily_turnover (mean of 1 - overlap over pairs of neighbouring days that both have fires)."""
    f = df.withColumn("fire", F.coalesce("fire", F.lit(False)))
    by_name = f.groupBy("ticker").agg(F.count_if("fire").alias("k")).where("k > 0").withColumn("r", F.row_number().over(Window.orderBy(F.desc("k"), "ticker")))
    top = by_name.agg(F.count("*").alias("names"), C.div(F.sum(F.when(F.col("r") <= 10, F.col("k"))), F.sum("k")).alias("top10"), F.max("k").alias("most"))
    often = by_name.where(F.col("r") <= longest_of).select("ticker")
    run = C.run_length(f.join(F.broadcast(often), "ticker", "left_semi"), "fire", "run").agg(F.coalesce(F.max("run"), F.lit(0)).cast("long").alias("max_consecutive"))
    f = f.withColumn("_p", F.coalesce(F.lag("fire").over(C.by_time()), F.lit(False)))
    day = f.groupBy("t").agg(F.count_if("fire").alias("k"), F.count_if("_p").alias("p"), F.count_if(F.col("fire") & F.col("_p")).alias("both"), F.count_if(F.col("fire") | F.col("_p")).alias("any"))
    pair = (F.col("k") > 0) & (F.col("p") > 0)
    days = day.agg(F.sum("k").alias("fires"), F.coalesce(F.avg(F.when(F.col("k") > 0, F.col("k"))), F.lit(0.0)).alias("fires_per_day"), F.avg((F.col("k") > 0).cast("double")).alias("active"), F.count("*").alias("days"), F.avg(F.when(pair, 1 - F.col("both") / F.col("any"))).alias("daily_turnover"))
    return days.crossJoin(top).crossJoin(run).withColumn("max_name_share", F.col("most") / F.col("days")).drop("most", "days")


def _bin(rank, bins: int):
    """The bin d with d / bins <= rank < (d + 1) / bins, the last one closed; by comparisons, so that a rank on an edge falls as it does there."""
    return sum((F.when(rank >= F.lit(d / bins), 1).otherwise(0) for d in range(1, bins)), F.lit(0))


def decile_profile(df: DataFrame, bins: int = 10, in_bin: int = 3, pool: int = 30, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, bin, excess_bp, days: mean over days of each bin's mean return less the pool's. Names are ranked by factor among the eligible; the pool is every eligible name with a return."""
    date = (*keys, "t")
    x = df.withColumn("_r", C.pct_rank("factor", "eligible", date)).where(F.col("eligible") & F.col("fwd").isNotNull())
    w = Window.partitionBy(*date)
    x = x.withColumn("_m", F.avg("fwd").over(w)).withColumn("_n", F.count("*").over(w)).where((F.col("_n") >= pool) & F.col("_r").isNotNull()).withColumn("bin", _bin(F.col("_r"), bins))
    d = x.groupBy(*date, "bin").agg(F.count("*").alias("k"), F.avg(F.col("fwd")).alias("a"), F.first("_m").alias("m")).where(F.col("k") >= in_bin)
    return d.groupBy(*keys, "bin").agg((F.avg(F.col("a") - F.col("m")) * 1e4).alias("excess_bp"), F.count("*").alias("days"))


def profile_shape(profile: DataFrame, bins: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, rho (rank correlation of a decile profile with its bins), spread_bp (last bin less first; NULL if either is missing)."""
    x = profile.withColumn("_r", C.pct_rank("excess_bp", partition=keys or ("_one",))) if keys else profile.withColumn("_one", F.lit(0)).withColumn("_r", C.pct_rank("excess_bp", partition=("_one",)))
    end = lambda k: F.max(F.when(F.col("bin") == k, F.col("excess_bp")))
    return x.groupBy(*keys).agg(F.corr("_r", "bin").alias("rho"), (end(bins - 1) - end(0)).alias("spread_bp"))


def paired_diff(df: DataFrame, base: str, alt: str, lag: int = 21, least: int = 5, days: int = 30) -> DataFrame:
    """One row: mean, t, n of the same-day difference of the mean cum between two conditions, on days on which both have at least `least` names; NULL below `days` days."""
    known = F.col("cum").isNotNull()
    d = df.groupBy("t").agg(F.count_if(known & F.col(base)).alias("a"), F.count_if(known & F.col(alt)).alias("b"), (F.avg(F.when(F.col(alt), F.col("cum"))) - F.avg(F.when(F.col(base), F.col("cum")))).alias("d"))
    return stats.newey_west(d.where((F.col("a") >= least) & (F.col("b") >= least)), "d", lag, least=days).select("mean", "t", "n")


def dummy_neutralized(df: DataFrame, controls: list[str], keys: tuple[str, ...] = (), least: int = 30) -> DataFrame:
    """keys, t, raw, neutral: per date, what firing adds to cum among names with a return and all controls, alone and beside the controls (least squares on [1, fire, controls]). Dates need `least` names, 3 fires and 3 without."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        d, y = x["fire"].to_numpy(float), x["cum"].to_numpy(float)
        raw = neutral = None
        if len(x) >= least and 3 <= d.sum() <= len(x) - 3:
            raw = float(y[d > 0].mean() - y[d == 0].mean())
            q, _ = np.linalg.qr(np.column_stack((np.ones(len(x)), x[controls].to_numpy(float))))
            e = d - q @ (q.T @ d)
            neutral = float(e @ y / (e @ e)) if e @ e > 1e-10 * len(x) else None
        return pd.DataFrame({**{k: [x[k].iloc[0]] for k in keys}, "t": [x["t"].iloc[0]], "raw": [raw], "neutral": [neutral]})

    kinds = dict(df.dtypes)
    x = df.where("eligible").select(*keys, "t", "fire", "cum", *controls).dropna()
    return x.groupBy(*keys, "t").applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "t int, raw double, neutral double"]))


def neutral_survival(coefficients: DataFrame, lag: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, raw, raw_t, neutral, neutral_t, survival (neutral over raw): Newey-West means of `dummy_neutralized`."""
    a, b = (stats.newey_west(coefficients, c, lag, keys).select(*keys, F.col("mean").alias(c), F.col("t").alias(f"{c}_t")) for c in ("raw", "neutral"))
    both = a.join(b, list(keys)) if keys else a.crossJoin(b)
    return both.withColumn("survival", F.when(F.abs("raw") > 1e-9, F.col("neutral") / F.col("raw")))


def ic_daily(df: DataFrame, least: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, t, ic, n: rank correlation of factor and fwd among eligible names that have both."""
    x = df.where(F.col("eligible") & F.col("fwd").isNotNull() & F.col("factor").isNotNull())
    date = (*keys, "t")
    x = x.select(*date, C.pct_rank("factor", partition=date).alias("a"), C.pct_rank("fwd", partition=date).alias("b"))
    return x.groupBy(*date).agg(F.corr("a", "b").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)


def ic_report(ic: DataFrame, least: int = 30, lag: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, days, mean, std, hit, icir, t (Newey-West; lag is the horizon, as forward windows overlap)."""
    a = ic.groupBy(*keys).agg(F.count("ic").alias("days"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("hit"))
    nw = stats.newey_west(ic, "ic", max(1, lag), keys, least=least).select(*keys, "t")
    a = a.join(nw, list(keys), "left") if keys else a.crossJoin(nw)
    enough = F.col("days") >= least
    return a.select(*keys, "days", *(F.when(enough, F.col(c)).alias(c) for c in ("mean", "std", "hit")), F.when(enough, C.div("mean", "std")).alias("icir"), F.when(enough, F.col("t")).alias("t"))


@dataclass(frozen=True)
class GateConfig:
    """Thresholds, to be fixed before a test. null_threshold: measured on shuffled factors, else fallback_t; min_neutral_survival: share of the raw excess that must be left after the controls, or no such gate."""

    null_threshold: float | None = None
    fallback_t: float = 3.0
    require_net_positive: bool = True
    require_subperiod_sign: bool = True
    min_monotonicity: float = 0.5
    min_yearly_positive: float = 0.6
    max_single_name_share: float = 0.5
    min_turnover: float = 0.05
    min_neutral_survival: float | None = None


def subperiod(values: DataFrame, x: str, lag: int) -> DataFrame:
    """half, mean, t: Newey-West for each half of the known values."""
    known = values.where(F.col(x).isNotNull())
    w = Window.orderBy("t")
    n = F.count("*").over(Window.partitionBy())
    return stats.newey_west(known.withColumn("half", F.when(F.row_number().over(w) <= F.floor(n / 2), 1).otherwise(2)), x, lag, ("half",))


def yearly(values: DataFrame, x: str, least: int = 40) -> DataFrame:
    """year, mean, n of years with enough bars."""
    return values.where(F.col(x).isNotNull()).groupBy(F.year("date").alias("year")).agg(F.avg(x).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)


def holdout(values: DataFrame, x: str, months: int = 12, least: int = 30) -> DataFrame:
    """part, n, mean: up to the last date less some months, and after it."""
    known = values.where(F.col(x).isNotNull())
    cut = known.agg(F.add_months(F.max("date"), -months).alias("cut"))
    p = known.crossJoin(F.broadcast(cut)).groupBy(F.when(F.col("date") <= F.col("cut"), "in").otherwise("out").alias("part"))
    return p.agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.avg(x)).alias("mean"))


def run_gates(t: float | None, net_bp: float | None, rho: float | None, halves: list[float], year_means: list[float], structure: dict | None = None, cfg: GateConfig = GateConfig(), survival: float | None = None) -> dict:
    """Each gate's verdict, and the first that fails. All are evaluated; an unknown figure fails the gate that needs it. structure: of `fire_structure`, or no such gate."""
    known = lambda x: x is not None and math.isfinite(x)
    threshold = cfg.fallback_t if cfg.null_threshold is None else cfg.null_threshold
    positive = sum(m > 0 for m in year_means)
    checks = {
        "G1 threshold": known(t) and abs(t) > threshold, "G2 net profit": not cfg.require_net_positive or known(net_bp) and net_bp > 0,
        "G3 halves": not cfg.require_subperiod_sign or len(halves) == 2 and all(map(known, halves)) and (halves[0] > 0) == (halves[1] > 0), "G4 monotone": known(rho) and abs(rho) >= cfg.min_monotonicity,
        "G5 years": bool(year_means) and positive / len(year_means) >= cfg.min_yearly_positive,
    }
    if structure is not None:
        a, b = structure["max_name_share"], structure["daily_turnover"]
        checks["G6 structure"] = known(a) and known(b) and a <= cfg.max_single_name_share and b >= cfg.min_turnover
    if cfg.min_neutral_survival is not None:
        checks["G7 neutral"] = known(survival) and survival >= cfg.min_neutral_survival
    return {"passed": all(checks.values()), "first_failure": next((k for k, v in checks.items() if not v), None), "gates": checks, "threshold": threshold}


def attribution(h: DataFrame, by: str) -> DataFrame:
    """by, contribution, long, short, exposure: sums of h * fwd1 over the book, and of its gross value."""
    x = h.withColumn("_c", F.col("h") * F.col("fwd1"))
    return x.groupBy(by).agg(F.sum("_c").alias("contribution"), F.sum(F.when(F.col("h") > 0, F.col("_c")).otherwise(0.0)).alias("long"), F.sum(F.when(F.col("h") < 0, F.col("_c")).otherwise(0.0)).alias("short"), F.sum(F.abs("h")).alias("exposure"))


def terciles(value, among: str = "eligible"):
    """0, 1, 2 for the lowest, middle and highest third of the date's eligible names, -1 where unknown."""
    rank = C.pct_rank(value, among)
    return F.coalesce(F.least(F.greatest(F.ceil(rank * 3).cast("int") - 1, F.lit(0)), F.lit(2)), F.lit(-1))


def concentration(h: DataFrame, top: int = 10, bars: int = 5) -> DataFrame:
    """One row: n_positive and n_held names, top_share (of the positive contributions, from the `top` best names), best_share (of the total, from the best bars)."""
    x = h.withColumn("_c", F.col("h") * F.col("fwd1"))
    names = x.groupBy("ticker").agg(F.sum("_c").alias("c"), F.sum(F.abs("h")).alias("e")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("c"), "ticker")))
    positive = F.when(F.col("c") > 0, F.col("c"))
    a = names.agg(F.count(positive).alias("n_positive"), F.count_if(F.col("e") > 0).alias("n_held"), C.div(F.sum(F.when(F.col("r") <= top, positive)), F.sum(positive)).alias("top_share"))
    day = x.groupBy("t").agg(F.sum("_c").alias("c")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("c"), "t")))
    total = F.sum("c")
    return a.crossJoin(day.agg(F.when(total > 1e-12, F.sum(F.when(F.col("r") <= bars, F.col("c"))) / total).alias("best_share")))


def brinson(df: DataFrame) -> DataFrame:
    """grp, allocation, selection, interaction of long-only weights h against benchmark weights b, from (t, grp, h, b, fwd1); cash is the group "(cash)", which earns 0. Days without benchmark are left out. Short positions and sums above 1 are refused."""
    shorts, most = df.withColumn("_s", F.sum("h").over(C.by_date())).agg(F.count_if(F.col("h") < -1e-12), F.max("_s")).first()
    if shorts or (most or 0) > 1 + 1e-9:
        raise ValueError("the attribution needs a long-only book whose weights sum to 1 or less")
    g = df.groupBy("t", F.coalesce("grp", F.lit("(no group)")).alias("grp")).agg(F.sum("h").alias("wp"), F.sum("b").alias("wb"), F.sum(F.col("h") * F.col("fwd1")).alias("cp"), F.sum(F.col("b") * F.col("fwd1")).alias("cb"))
    cash = g.groupBy("t").agg(F.lit("(cash)").alias("grp"), F.greatest(1 - F.sum("wp"), F.lit(0.0)).alias("wp"), F.lit(0.0).alias("wb"), F.lit(0.0).alias("cp"), F.lit(0.0).alias("cb"))
    g = g.unionByName(cash).withColumn("_b", F.sum("wb").over(C.by_date())).where("_b > 0")
    part = lambda c, w: F.when(F.col(w) > 1e-15, F.col(c) / F.col(w)).otherwise(0.0)
    g = g.withColumn("rb", part("cb", "wb")).withColumn("rp", part("cp", "wp")).withColumn("all", F.sum("cb").over(C.by_date()))
    over, own = F.col("wp") - F.col("wb"), F.col("rp") - F.col("rb")
    return g.groupBy("grp").agg(F.sum(over * (F.col("rb") - F.col("all"))).alias("allocation"), F.sum(F.col("wb") * own).alias("selection"), F.sum(over * own).alias("interaction"))


def holdings_summary(h: DataFrame, periods: int = 252) -> DataFrame:
    """One row: for each side the mean names held, effective names (1 over the sum of squared shares) and largest share on bars with a position; turnover a bar, trades a year, mean trade, mean gross value, and how many bars a unit stays invested."""
    w = C.by_time()
    x = h.withColumn("_d", F.abs(F.col("h") - F.lag("h").over(w)))
    side = {"long": F.greatest("h", F.lit(0.0)), "short": F.greatest(-F.col("h"), F.lit(0.0))}
    day = x.groupBy("t").agg(
        (F.coalesce(F.sum("_d"), F.lit(0.0)) / 2).alias("turnover"), F.count_if(F.col("_d") > 1e-9).alias("k"), F.sum(F.when(F.col("_d") > 1e-9, F.col("_d"))).alias("moved"), F.sum(F.abs("h")).alias("gross"), F.count("_d").alias("pairs"),
        *(f.alias(f"{n}_{c}") for n, v in side.items() for c, f in (("s", F.sum(v)), ("k", F.count_if(v > 1e-12)), ("q", F.sum(v * v)), ("m", F.max(v)))),
    )
    out = []
    for n in side:
        has = F.col(f"{n}_s") > 1e-12
        out += [F.coalesce(F.avg(F.when(has, v)), F.lit(0.0)).alias(f"{c}_{n}") for c, v in (("avg", F.col(f"{n}_k")), ("effective_n", F.col(f"{n}_s") * F.col(f"{n}_s") / F.col(f"{n}_q")), ("max_weight", F.col(f"{n}_m") / F.col(f"{n}_s")))]
    per_bar = F.avg(F.when(F.col("pairs") > 0, F.col("turnover")))
    return day.agg(*out, per_bar.alias("turnover"), (F.sum("k") / (F.count("*") / periods)).alias("trades_per_year"), C.div(F.sum("moved"), F.sum("k")).alias("avg_trade"), F.avg("gross").alias("gross"), C.div(F.avg("gross"), per_bar).alias("holding_bars"))
