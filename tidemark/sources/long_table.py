"""Strict door for long tables: one row per (id, date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import joins
from ..operators.panel import Panel


def checks(df: DataFrame, id_col: str = "id", date_col: str = "date", close_col: str = "close") -> DataFrame:
    """One row: rows, repeated (id, date), null keys, prices that are not positive."""
    twice = df.groupBy(id_col, date_col).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("repeated"))
    one = df.agg(F.count("*").alias("rows"), F.count_if(F.col(id_col).isNull() | F.col(date_col).isNull()).alias("null_keys"), F.count_if(F.col(close_col) <= 0).alias("bad_prices"))
    return one.crossJoin(twice)


def panel_from_long(
    df: DataFrame, *, id_col: str = "id", date_col: str = "date", close_col: str = "close", volume_col: str | None = "volume", open_col: str | None = None, high_col: str | None = None, low_col: str | None = None, mkt_cap_col: str | None = None,
    in_universe_col: str | None = None, delist_return_col: str | None = None, ticker_col: str | None = None, min_age: int = 60, adv_window: int = 30, min_adv: float | None = None, ended_gap_days: int = 30, **scalars,
) -> Panel:
    """A panel with age and traded-value eligibility (and in_universe, where a column says so); a final return is compounded into the last close; ended securities are flagged. meta: rows, ended, delisting returns applied, codes that several ids use."""
    extra = {"volume": volume_col, "open": open_col, "high": high_col, "low": low_col, "mkt_cap": mkt_cap_col, "_in": in_universe_col, "_dl": delist_return_col}
    for c in (id_col, date_col, close_col, ticker_col, *extra.values()):
        if c and c not in df.columns:
            raise KeyError(c)
    found = checks(df, id_col, date_col, close_col).first()
    if found["repeated"] or found["null_keys"] or found["bad_prices"]:
        raise ValueError(f"repeated keys: {found['repeated']}, null keys: {found['null_keys']}, prices <= 0: {found['bad_prices']}")
    x = df.select(F.col(id_col).alias("ticker"), F.col(date_col).alias("date"), F.col(close_col).alias("close"), *(F.col(v).alias(k) for k, v in extra.items() if v))
    if not delist_return_col:
        x = x.withColumn("_dl", F.lit(None).cast("double"))
    w = Window.partitionBy("ticker")
    end = x.agg(F.max("date").alias("_end"))
    x = x.crossJoin(F.broadcast(end)).withColumn("_lastd", F.max("date").over(w))
    last = F.col("date") == F.col("_lastd")
    ended = last & (F.datediff("_end", "_lastd") > ended_gap_days)
    x = x.withColumn("delist_after", ended).withColumn("_hit", ended & F.col("_dl").isNotNull()).withColumn("close", F.when(F.col("_hit"), F.col("close") * (1 + F.col("_dl"))).otherwise(F.col("close")))
    counts = x.agg(F.count("*").alias("rows"), F.count_if("delist_after").alias("ended"), F.count_if("_hit").alias("delist_returns")).first().asDict()
    spine = joins.align(joins.spine(x), x.drop("_end", "_lastd", "_dl", "_hit"))
    ok = F.col("close").isNotNull() & (F.count("close").over(C.by_time()) >= min_age)
    if min_adv is not None:
        ok &= F.coalesce(C.rolling_median(F.col("close") * F.col("volume"), adv_window) >= min_adv, F.lit(False))
    if in_universe_col:
        ok &= F.coalesce(F.col("_in").cast("boolean"), F.lit(False))
    df2 = spine.withColumn("eligible", F.coalesce(ok, F.lit(False))).withColumn("delist_after", F.coalesce("delist_after", F.lit(False))).drop("_in")
    return Panel(df2, meta=counts | ({"reused": reused(df, id_col, ticker_col)} if ticker_col else {}), **scalars)


def reused(df: DataFrame, id_col: str, ticker_col: str) -> list[str]:
    """Tickers that several ids use."""
    return [r[0] for r in df.groupBy(ticker_col).agg(F.countDistinct(id_col).alias("n")).where("n > 1").orderBy(ticker_col).select(ticker_col).collect()]


def split_reused_codes(bars: DataFrame, gap_days: int = 120) -> DataFrame:
    """bars with sid: a code is a new security after a gap of more than gap_days."""
    w = Window.partitionBy("ticker").orderBy("date")
    x = bars.withColumn("_g", F.coalesce((F.datediff("date", F.lag("date").over(w)) > gap_days).cast("int"), F.lit(0)))
    x = x.withColumn("_k", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("sid", F.when(F.col("_k") == 0, F.col("ticker")).otherwise(F.concat_ws("~", "ticker", F.col("_k").cast("string")))).drop("_g", "_k")


def chain_linked(bars: DataFrame, ret: str, base: float = 100.0) -> DataFrame:
    """bars with adjusted: base times the product of 1 + ret within sid; the first bar is the base."""
    w = Window.partitionBy("sid").orderBy("date")
    first = F.row_number().over(w) == 1
    r = F.when(first, 0.0).otherwise(F.coalesce(F.col(ret), F.lit(0.0)))
    return bars.withColumn("_r", r).withColumn("adjusted", base * F.product(1 + F.col("_r")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_r")


def universe_coverage(panel_tickers: DataFrame, master: DataFrame, years: list[int]) -> DataFrame:
    """year, listed, in_panel, stopped, stopped_in_panel of a security master (ticker, start, stop)."""
    y = master.sparkSession.createDataFrame([(k,) for k in years], "year int")
    m = master.join(panel_tickers.select("ticker", F.lit(True).alias("mine")).distinct(), "ticker", "left")
    x = F.broadcast(y).join(m, (F.year("start") <= F.col("year")) & (F.col("stop").isNull() | (F.year("stop") >= F.col("year"))))
    gone = F.col("stop").isNotNull() & (F.year("stop") == F.col("year"))
    return x.groupBy("year").agg(F.count("*").alias("listed"), F.count_if("mine").alias("in_panel"), F.count_if(gone).alias("stopped"), F.count_if(gone & F.col("mine")).alias("stopped_in_panel"))


def day_rows(raw: DataFrame, names: dict[str, str], numbers: tuple[str, ...]) -> DataFrame:
    """Vendor rows of strings with the given new names; "-" and empty strings are NULL, numbers (with or without thousands separators) doubles, and what is no number NULL."""
    clean = lambda c: F.when(F.trim(c).isin("", "-"), None).otherwise(F.trim(c))
    cells = {new: clean(F.col(old)) for old, new in names.items()}
    return raw.select(*((F.regexp_replace(v, ",", "").try_cast("double") if k in numbers else v).alias(k) for k, v in cells.items()))


def exchange_panel(
    days: DataFrame, *, reuse_gap_days: int = 120, min_age: int = 60, adv_window: int = 30, min_adv: float | None = None, common_only: bool = True, excluded_names: str | None = None, drop_suspect_above: float | None = None, ended_gap_days: int = 30, **scalars,
) -> Panel:
    """From an exchange's daily rows (date, ticker, name, market, close, change, open, high, low, volume, mkt_cap): reused codes split, returns against the day's reference price (close - change), a chain-linked close, flags, filters.

    common_only keeps codes that end in 0; excluded_names: a pattern of names to leave out. Returns above drop_suspect_above (in size) make the bar unknown; they are listed in meta["suspect"].
    """
    x = split_reused_codes(days.where("close IS NOT NULL"), reuse_gap_days)
    if common_only:
        x = x.where(F.col("ticker").endswith("0"))
    if excluded_names:
        x = x.where(~F.coalesce(F.col("name").rlike(excluded_names), F.lit(False)))
    x = x.withColumn("_ret", C.div("close", F.col("close") - F.col("change")) - 1)
    suspect = F.abs("_ret") > drop_suspect_above if drop_suspect_above is not None else F.lit(False)
    bad = x.where(F.coalesce(suspect, F.lit(False))).select("sid", "date", "_ret").orderBy("date", "sid").limit(1000).collect() if drop_suspect_above is not None else []
    x = chain_linked(x.withColumn("_ret", F.when(~F.coalesce(suspect, F.lit(False)), F.col("_ret"))), "_ret")
    scale = C.div("adjusted", "close")
    x = x.select(F.col("sid").alias("ticker"), "date", "market", F.col("close").alias("raw_close"), F.col("adjusted").alias("close"), *((F.when(F.col(c) > 0, F.col(c)) * scale).alias(c) for c in ("open", "high", "low")), "volume", "mkt_cap")
    end = x.agg(F.max("date").alias("_end"))
    x = x.crossJoin(F.broadcast(end)).withColumn("_l", F.max("date").over(Window.partitionBy("ticker")))
    x = x.withColumn("delist_after", (F.col("date") == F.col("_l")) & (F.datediff("_end", "_l") > ended_gap_days)).drop("_end", "_l")
    df = joins.align(joins.spine(x), x)
    ok = F.col("close").isNotNull() & (F.count("close").over(C.by_time()) >= min_age)
    if min_adv is not None:
        ok &= F.coalesce(C.rolling_median(F.col("raw_close") * F.col("volume"), adv_window) >= min_adv, F.lit(False))
    df = df.withColumn("eligible", F.coalesce(ok, F.lit(False))).withColumn("delist_after", F.coalesce("delist_after", F.lit(False)))
    return Panel(df, meta={"suspect": [tuple(r) for r in bad], "return_basis": "reference price"}, **({"market": "KR"} | scalars))


def stock_master(rows: DataFrame, exchanges: tuple[str, ...], alive_days: int = 7) -> DataFrame:
    """ticker, exchange, start, stop, alive_today of common stocks from a vendor's list (ticker, exchange, assetType, startDate, endDate): listed exchanges, plain tickers, a start date; alive is who ends within alive_days of the last end date."""
    m = rows.where(F.col("exchange").isin(*exchanges) & (F.lower("assetType") == "stock") & F.col("startDate").isNotNull() & F.col("ticker").rlike("^[A-Z]{1,5}$"))
    m = m.select("ticker", "exchange", F.to_date("startDate").alias("start"), F.to_date("endDate").alias("stop"))
    return m.crossJoin(F.broadcast(m.agg(F.max("stop").alias("_m")))).withColumn("alive_today", F.coalesce(F.datediff("_m", "stop") <= alive_days, F.lit(False))).drop("_m")
