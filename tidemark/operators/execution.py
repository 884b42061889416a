"""What can be traded: halts, suspensions, limits, bans, lots, and the path-dependent fill."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import columns as C
from . import costs, joins


def at_prices(df: DataFrame, price: str) -> DataFrame:
    return df.withColumn("close", F.when(F.col(price) > 0, F.col(price)))


def _halted(df: DataFrame) -> Column:
    """A price without volume; an unknown volume is none. Never, where the panel has no volumes."""
    return F.col("close").isNotNull() & ~F.coalesce(F.col("volume") > 0, F.lit(False)) if "volume" in df.columns else F.lit(False)


def halt_runs(df: DataFrame) -> DataFrame:
    """df with halt_run: how many bars in a row, this one included, have a price but no volume; 0 on others."""
    return C.run_length(df.withColumn("_h", _halted(df)), "_h", "halt_run").drop("_h")


def flagged_before(df: DataFrame) -> Column:
    """Whether an earlier bar of the security is flagged as its last."""
    if "delist_after" not in df.columns:
        return F.lit(False)
    return F.coalesce(F.max(F.coalesce("delist_after", F.lit(False))).over(C.by_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))


def tradability(df: DataFrame, limit: float | DataFrame | None = None, tol: float = 0.01, halt_on_zero_volume: bool = True, max_gap: int | None = 60) -> DataFrame:
    """df with can_buy, can_sell.

    Halted are bars without price and, where the panel has volumes, bars without a known positive volume. After a flagged last bar, and
    after more than max_gap bars without price, a position counts as settled: both trades are possible. limit: the daily price limit as a
    fraction, or a schedule (effective_date, value); a move of limit - tol up cannot be bought, one down cannot be sold.
    """
    halted = _halted(df) if halt_on_zero_volume else F.lit(False)
    x = C.run_length(df.withColumn("_n", F.col("close").isNull()), "_n", "_gap").withColumn("_ok", F.col("close").isNotNull() & ~halted | flagged_before(df))
    if max_gap is not None:
        x = x.withColumn("_ok", F.col("_ok") | (F.col("_gap") > max_gap))
    up = down = F.lit(False)
    if limit is not None:
        if isinstance(limit, DataFrame):
            lowest, highest = limit.agg(F.min("value"), F.max("value")).first()
            days = costs.rate_schedule(df.select("date").distinct(), limit).withColumnRenamed("value", "_lim")
            x, lim = x.join(F.broadcast(days), "date"), F.col("_lim")
        else:
            lowest = highest = float(limit)
            lim = F.lit(lowest)
        if not 0 < lowest <= highest < 1 or not 0 <= tol < lowest:
            raise ValueError("a limit is a fraction between 0 and 1, and tol at least 0 and below it")
        x = x.withColumn("_r", C.div("close", F.lag("close").over(C.by_time())) - 1)
        up, down = F.coalesce(F.col("_r") >= lim - tol, F.lit(False)), F.coalesce(F.col("_r") <= -(lim - tol), F.lit(False))
    x = x.withColumn("can_buy", F.col("_ok") & ~up).withColumn("can_sell", F.col("_ok") & ~down)
    return x.drop("_n", "_gap", "_ok", "_r", "_lim")


def freeze_hits(df: DataFrame, days: int, lag: int) -> DataFrame:
    """df with frozen: the execution day is exactly the `days`-th bar of a suspension."""
    if isinstance(days, bool) or not isinstance(days, int) or days < 1:
        raise ValueError(f"freeze_days must be a whole number of at least 1, got {days!r}")
    hit = F.lead(F.col("halt_run") == days, lag, False).over(C.by_time()) if lag else F.col("halt_run") == days
    return halt_runs(df).withColumn("frozen", hit).drop("halt_run")


def check_freeze_return(x: float) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not -1.0 <= x <= 0.0:
        raise ValueError(f"freeze_return must be between -1 and 0, got {x!r}")
    return float(x)


def freeze_episodes(df: DataFrame, min_days: int = 20, relist_days: int = 20) -> DataFrame:
    """One row for each suspension (a price without volume) of at least min_days bars: ticker, start_t, end_t, days, outcome, ret.

    resumed: the next price against the last one before the suspension. resumed_then_delisted: the security is flagged and its last bar
    is within relist_days of that next price; ret is to the last price. ended_in_halt: a flagged security's last bar is in the suspension;
    ret is 0. ongoing: no price follows, or the panel ends; ret is NULL, as it is where no price stands before the suspension.
    """
    w = C.by_time()
    every = Window.partitionBy("ticker")
    priced = F.when(F.col("close").isNotNull(), F.struct("t", "close"))
    flag = F.coalesce(F.col("delist_after"), F.lit(False)) if "delist_after" in df.columns else F.lit(False)
    x = df.withColumn("_h", _halted(df)).withColumn("_end", F.max("t").over(Window.partitionBy())).select(
        "t", "ticker", "_h", "_end", F.max(flag).over(every).alias("flagged"), F.max(priced).over(every).alias("last"),
        F.last(F.when(~F.col("_h"), F.col("close")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first(priced, True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
    )
    x = x.where("_h").withColumn("island", F.col("t") - F.row_number().over(w))
    e = x.groupBy("ticker", "island").agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("days"), F.min_by("before", "t").alias("before"), F.max_by("next", "t").alias("next"), F.first("last").alias("last"), F.first("flagged").alias("flagged"), F.first("_end").alias("end"),
    ).where(F.col("days") >= min_days)
    dead = F.col("flagged") & (F.col("last.t") == F.col("end_t"))
    outcome = F.when(dead, "ended_in_halt").when((F.col("end_t") == F.col("end")) | F.col("next").isNull(), "ongoing").when(F.col("flagged") & (F.col("last.t") - F.col("next.t") <= relist_days), "resumed_then_delisted").otherwise("resumed")
    e = e.withColumn("outcome", outcome)
    ret = F.when(F.col("outcome") == "ended_in_halt", F.when(F.col("before").isNotNull(), 0.0)).when(F.col("outcome") == "resumed_then_delisted", C.div("last.close", "before") - 1).when(F.col("outcome") == "resumed", C.div("next.close", "before") - 1)
    return e.select("ticker", "start_t", "end_t", "days", "outcome", ret.alias("ret"))


def exec_masks(lag: int) -> dict[str, Column]:
    """can_buy, can_sell as read on the execution day; true past the end."""
    return {c: F.lead(c, lag, True).over(C.by_time()) for c in ("can_buy", "can_sell")}


def round_to_lots(w: str, price: str, capital: float, lot: float = 1.0) -> Column:
    """Weights in whole lots, halves to even."""
    return F.coalesce(C.half_even(C.div(F.col(w) * capital, F.col(price) * lot)) * lot * F.col(price) / capital, F.lit(0.0))


def shortable_from_bans(spine: DataFrame, bans: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """spine with shortable: false within any ban (start, stop inclusive, NULL stop open) unless exempt. Bans are few dated periods."""
    days = spine.select("date").distinct()
    hit = (F.col("date") >= F.col("start")) & (F.col("stop").isNull() | (F.col("date") <= F.col("stop")))
    banned = days.join(bans, hit, "left_semi").withColumn("_b", F.lit(True))
    free = F.col("ticker").isin(exempt) if exempt else F.lit(False)
    return spine.join(banned, "date", "left").withColumn("shortable", F.col("_b").isNull() | free).drop("_b")


def listing_windows(bars: DataFrame, master: DataFrame) -> DataFrame:
    """Bars within their security's listing window (ticker, start, stop)."""
    return joins.in_ranges(bars, "date", master, "start", "stop", "ticker").select(*bars.columns)


def realize(
    target: DataFrame, keys: tuple[str, ...] = (), cap_gross: bool = False, *, capital: float | None = None, least_trade: float = 0.0, books: int = 64,
) -> DataFrame:
    """keys, t, ticker, h, and tgt (what was to be held), d (the trade asked for), blocked, skipped, k (the day's scale): what is held when blocked trades stay undone.

    target: keys, t, ticker, w, can_buy, can_sell (NULL: possible), and with capital: price (of the day of the trade), lot (NULL: 1), least
    (NULL: least_trade; money). Row 0 is a build from cash. A blocked or too small trade leaves the weight as it is, and so does a weight without price, unless it is 0.
    Without cap_gross names are independent, and are dealt to `books` groups; with it the whole target of a day is scaled by the largest k
    in [0, 1], found by bisection, for which the gross value is not above the target's, which couples all names of one book: one group for each of `keys`.
    """

    def path(x: pd.DataFrame) -> pd.DataFrame:
        wide = lambda c: x.pivot(index="t", columns="ticker", values=c)
        w = wide("w")
        at = w.fillna(0).to_numpy(float)
        buy, sell = (wide(c).astype("boolean").fillna(True).to_numpy(bool) for c in ("can_buy", "can_sell"))
        if capital is not None:
            price, lot, least = wide("price").to_numpy(float), wide("lot").fillna(1.0).to_numpy(float), wide("least").fillna(least_trade).to_numpy(float)
        rows, names = at.shape
        out = {c: np.zeros(at.shape) for c in ("h", "tgt", "d", "blocked", "skipped", "k")}
        prev = np.zeros(names)

        def decide(raw: np.ndarray, t: int) -> tuple[np.ndarray, ...]:
            want = raw
            if capital is not None:
                with np.errstate(divide="ignore", invalid="ignore"):
                    whole = np.round(raw * capital / price[t] / lot[t]) * lot[t] * price[t] / capital
                want = np.where(raw == 0, 0.0, np.where(np.isfinite(whole), whole, prev))
            d = want - prev
            small = (np.abs(d) * capital < least[t]) & (d != 0) if capital is not None else np.zeros(names, bool)
            return want, d, small, (d > 0) & ~buy[t] | (d < 0) & ~sell[t]

        for t in range(rows):
            k, raw = 1.0, at[t]
            want, d, small, stuck = decide(raw, t)
            if cap_gross:
                room = np.abs(want).sum() + 1e-12

                def gross(scale: float) -> float:
                    a, _, b, c = decide(at[t] * scale, t)  # noqa: B023
                    return float(np.abs(np.where(b | c, prev, a)).sum())

                if gross(1.0) > room:
                    lo, hi = 0.0, 1.0
                    if gross(0.0) > room:
                        hi = 0.0
                    while hi - lo > 1e-14:
                        middle = (lo + hi) / 2
                        lo, hi = (middle, hi) if gross(middle) <= room else (lo, middle)
                    k = lo
                    want, d, small, stuck = decide(raw * k, t)
            prev = np.where(small | stuck, prev, want)
            for c, v in (("h", prev), ("tgt", want), ("d", d), ("blocked", stuck & ~small), ("skipped", small), ("k", k)):
                out[c][t] = v
        index = {"t": np.repeat(w.index.to_numpy(), names), "ticker": np.tile(w.columns.to_numpy(), rows)}
        long = pd.DataFrame(index | {c: v.ravel() for c, v in out.items()}).astype({"blocked": bool, "skipped": bool})
        for c in keys:
            long[c] = x[c].iloc[0]
        return long[[*keys, "t", "ticker", *out]]

    kinds = {f.name: f.dataType.simpleString() for f in target.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"t {kinds['t']}", "ticker string", "h double", "tgt double", "d double", "blocked boolean", "skipped boolean", "k double"])
    for c in ("lot", "least") if capital is not None else ():
        if c not in target.columns:
            target = target.withColumn(c, F.lit(None).cast("double"))
    part = F.lit(0) if cap_gross else F.pmod(F.xxhash64("ticker"), F.lit(books))
    return target.withColumn("_book", part).groupBy(*keys, "_book").applyInPandas(path, schema)


def fill_statistics(filled: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and, of the rows of `realize`: blocked and skipped trades with their shares of the turnover asked for, mean stuck weight, longest freeze, mean scale, days that no scale could fit."""
    first = F.min("t").over(Window.partitionBy(*keys))
    x = filled.withColumn("_own", F.concat_ws("\x01", *[F.col(k).cast("string") for k in keys], "ticker")).withColumn("_later", F.col("t") > first)
    x = C.run_length(x, "blocked", "_run", key="_own")
    size = F.abs("d")
    day = x.groupBy(*keys, "t").agg(
        F.sum(F.when(F.col("blocked"), F.abs(F.col("h") - F.col("tgt"))).otherwise(0.0)).alias("stuck"), F.max("_run").alias("run"), F.min("k").alias("k"),
        F.sum(F.when(F.col("_later"), size).otherwise(0.0)).alias("asked"), F.sum(F.when(F.col("_later") & F.col("blocked"), size).otherwise(0.0)).alias("b"), F.sum(F.when(F.col("_later") & F.col("skipped"), size).otherwise(0.0)).alias("s"),
        F.count_if(F.col("_later") & F.col("blocked")).alias("nb"), F.count_if(F.col("_later") & F.col("skipped")).alias("ns"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return day.groupBy(*keys).agg(
        F.avg("stuck").alias("mean_stuck_weight"), F.max("run").cast("long").alias("longest_freeze"), F.sum("asked").alias("asked_turnover"), F.sum("nb").alias("blocked_trades"), zero(C.div(F.sum("b"), F.sum("asked"))).alias("blocked_share"),
        F.sum("ns").alias("skipped_trades"), zero(C.div(F.sum("s"), F.sum("asked"))).alias("skipped_share"), F.avg("k").alias("mean_scale"), F.count_if(F.col("k") == 0).alias("infeasible_days"),
    )


def held_without_price(df: DataFrame, held: Column, lag: int) -> DataFrame:
    """One row: n, first_t, first_ticker of the positions whose return cannot be booked, because the price of the entry or of the bar after it is missing; not on or after a flagged last bar."""
    w = C.by_time()
    missing = F.lead("close", lag).over(w).isNull() | F.lead("close", lag + 1).over(w).isNull()
    if "delist_after" in df.columns:
        gone = F.max(F.coalesce("delist_after", F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, lag + 1))
        missing = missing & ~F.coalesce(gone, F.lit(False))
    x = df.withColumn("_m", missing & held).withColumn("_end", F.max("t").over(Window.partitionBy())).where(F.col("_m") & (F.col("t") < F.col("_end") - lag))
    return x.agg(F.count("*").alias("n"), F.min(F.struct("t", "ticker")).alias("f")).select("n", F.col("f.t").alias("first_t"), F.col("f.ticker").alias("first_ticker"))
