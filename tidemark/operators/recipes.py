"""Factor recipes and regression controls over the dense panel; every one is a Column, so that a set of them shares one window stage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columns as C
from .panel import Panel, ret

def _value() -> Column:
    return F.col("close") * F.col("volume")


def momentum(lookback: int, skip: int) -> Column:
    return C.div(F.lag("close", skip).over(C.by_time()), F.lag("close", lookback).over(C.by_time())) - 1


def reversal(lookback: int = 5) -> Column:
    return -ret(lookback)


def low_volatility(window: int = 60, r: str = "ret1") -> Column:
    """Needs ret1 as a column; at least two thirds of the window, and 3."""
    return -C.rolling(F.stddev_samp, r, window, max(3, 2 * window // 3))


def size() -> Column:
    return F.when(F.col("mkt_cap") > 0, -F.col("mkt_cap"))


def illiquidity(window: int = 30) -> Column:
    return -C.rolling(F.avg, _value(), window)


def volume_shock(short: int = 5, window: int = 60) -> Column:
    return C.div(C.rolling(F.avg, "volume", short), C.rolling(F.avg, "volume", window)) - 1


def distance_to_high(window: int) -> Column:
    return C.div("close", C.rolling(F.max, "close", window)) - 1


RECIPES = {"momentum": momentum, "reversal": reversal, "low_volatility": low_volatility, "size": size, "illiquidity": illiquidity, "volume_shock": volume_shock, "distance_to_high": distance_to_high}


def names() -> list[str]:
    return sorted(RECIPES)


def describe(name: str) -> dict:
    """What a recipe computes, its parameters with their defaults, and the columns that it needs beyond close."""
    import inspect

    if name not in RECIPES:
        raise KeyError(f"no recipe {name!r}; there are {', '.join(names())}")
    needs = {"low_volatility": ["ret1"], "size": ["mkt_cap"], "illiquidity": ["volume"], "volume_shock": ["volume"]}
    return {"name": name, "does": (inspect.getdoc(RECIPES[name]) or "").split("\n")[0], "parameters": {k: None if v.default is v.empty else v.default for k, v in inspect.signature(RECIPES[name]).parameters.items()}, "needs": needs.get(name, [])}


def recipe(name: str, periods_per_year: int = 252, **parameters) -> Column:
    """A recipe by name. Windows that span a year, or a month, have defaults from periods_per_year."""
    if name not in RECIPES:
        raise KeyError(f"no recipe {name!r}; there are {', '.join(names())}")
    defaults = {"momentum": {"lookback": periods_per_year, "skip": max(1, periods_per_year // 12)}, "distance_to_high": {"window": periods_per_year}}
    given = defaults.get(name, {}) | parameters
    for k, v in given.items():
        if isinstance(v, bool) or not isinstance(v, str | int) or isinstance(v, int) and v < (0 if k == "skip" else 1):
            raise ValueError(f"{k} must be a whole number of at least 1, got {v!r}")
    if name == "momentum" and given["skip"] >= given["lookback"]:
        raise ValueError("skip must be below lookback")
    return RECIPES[name](**given)


def registered(name: str, build: Callable[..., Column]) -> None:
    """Add a recipe of one's own."""
    if name in RECIPES:
        raise ValueError(f"there is a recipe {name!r} already")
    RECIPES[name] = build


def controls(p: Panel) -> DataFrame:
    """df with ranked controls c_rev1, c_rev5, c_mom21, c_mom63, c_vol21, c_mom252_21 (where the panel is longer than a year and 21 bars), c_logsize, c_turnover and c_char_*, as the panel allows."""
    df = p.df.withColumn("ret1", ret(1))
    raw = {"rev1": F.col("ret1"), "rev5": ret(5), "mom21": ret(21), "mom63": ret(63), "vol21": C.rolling(F.stddev_samp, "ret1", 21)}
    if p.periods_per_year < p.df.agg(F.max("t")).first()[0] + 1 - 21:
        raw["mom252_21"] = ret(p.periods_per_year) - ret(21)
    if p.has("mkt_cap"):
        raw["logsize"] = F.when(F.col("mkt_cap") > 0, F.ln("mkt_cap"))
        if p.has("volume"):
            raw["turnover"] = C.div(C.rolling(F.avg, _value(), 20), "mkt_cap")
    raw |= {c: F.col(c) for c in p.df.columns if c.startswith("char_")}
    df = df.select("*", *(v.alias(f"_{k}") for k, v in raw.items()))
    return df.select(*(c for c in df.columns if c[1:] not in raw), *(C.xs_norm(f"_{k}", "eligible").alias(f"c_{k}") for k in raw))


def neutralize(df: DataFrame, factor: str, by: list[str], least: int = 50) -> DataFrame:
    """t, ticker, residual: per date, the factor without what the controls explain (least squares on 1 and by). Dates with fewer names, or nothing left, give none."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.dropna()
        if len(x) < least:
            return pd.DataFrame({"t": [], "ticker": [], "residual": []}).astype({"t": "int32", "ticker": "object", "residual": "float64"})
        y, m = x[factor].to_numpy(float), np.column_stack((np.ones(len(x)), x[by].to_numpy(float)))
        q, _ = np.linalg.qr(m)
        e = y - q @ (q.T @ y)
        return pd.DataFrame({"t": x["t"], "ticker": x["ticker"], "residual": e if e.std() > 1e-5 * y.std() else np.full(len(e), np.nan)}).dropna()

    return df.where("eligible").select("t", "ticker", factor, *by).groupBy("t").applyInPandas(run, "t int, ticker string, residual double")


def characteristics_from_financials(df: DataFrame) -> DataFrame:
    """df (t, ticker, close, mkt_cap, equity, net_income, assets; the last three known by then and carried forward) with char_log_size, char_momentum (a year without its last month), char_log_bm (at least ln 1e-6), char_roa, char_asset_growth; those whose inputs the frame lacks are left out."""
    has = set(df.columns)
    out = {"log_size": F.when(F.col("mkt_cap").isNotNull(), F.ln(F.greatest("mkt_cap", F.lit(1.0)))), "momentum": ret(252) - ret(21)}
    if "equity" in has:
        ratio = C.div("equity", "mkt_cap")
        out["log_bm"] = F.when(ratio.isNotNull(), F.ln(F.greatest(ratio, F.lit(1e-6))))
    if {"net_income", "assets"} <= has:
        out["roa"] = C.div("net_income", "assets")
    if "assets" in has:
        out["asset_growth"] = C.div("assets", F.lag("assets", 252).over(C.by_time())) - 1
    return df.select("*", *(v.alias(f"char_{k}") for k, v in out.items()))
