"""Structured Streaming: closed bars, runs of activity, last rows of keys, eligibility of the day before, and fills that remember their position."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.bars import aggregate_bars


def closed_bars(minutes: DataFrame, bar: str, delay: str = "2 minutes", by: str = "symbol") -> DataFrame:
    """Bars of a stream in append mode: a bar comes out once the watermark has passed its end, so an unfinished one never does."""
    return aggregate_bars(minutes.withWatermark("ts", delay), bar, by)


def sessions(events: DataFrame, gap: str, by: str, delay: str | None = None) -> DataFrame:
    """by, start, stop, n: runs of events with no pause of `gap` or more; delay: the watermark, for a stream."""
    e = events.withWatermark("ts", delay) if delay else events
    g = e.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def latest(rows: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """keys, ts and the other columns of the last row of each key within a watermark: in append mode a key's row comes out once no later one can arrive. keys must hold the event time, or the key is never closed."""
    if ts not in keys:
        raise ValueError("the event time has to be one of the keys")
    rest = [c for c in rows.columns if c not in keys]
    stream = rows.withWatermark(ts, delay)
    order = F.struct("_seen") if "_seen" in rows.columns else F.struct(*rest)
    g = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    return g.select(*keys, *(F.col("_v")[c].alias(c) for c in rest))


def with_daily(bars: DataFrame, daily: DataFrame, by: str = "symbol") -> DataFrame:
    """A stream of bars (symbol, bar_end) with eligible, by a static table of days (symbol, day, ok): whether the symbol was fit on the day before."""
    day = F.date_sub(F.to_date(F.col("bar_end") - F.expr("INTERVAL 1 MINUTE")), 1)
    known = daily.select(by, F.col("day").alias("_day"), F.col("ok").alias("_ok"))
    return bars.withColumn("_day", day).join(known, [by, "_day"], "left").withColumn("eligible", F.coalesce("_ok", F.lit(False))).drop("_day", "_ok")


def fills(targets: DataFrame, timeout: str = "NoTimeout") -> DataFrame:
    """ticker, t, h of a stream of targets (ticker, t, w, can_buy, can_sell) that arrive in order of t for each ticker: a blocked trade leaves the position as it was. The position is the state of its ticker."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(parts)).sort_values("t")
        out = []
        for w, buy, sell in zip(rows["w"], rows["can_buy"], rows["can_sell"], strict=True):
            if not (w > held and not buy or w < held and not sell):
                held = float(w)
            out.append(held)
        state.update((held,))
        yield pd.DataFrame({"ticker": key[0], "t": rows["t"].to_numpy(), "h": out})

    return targets.groupBy("ticker").applyInPandasWithState(run, "ticker string, t long, h double", "h double", "append", GroupStateTimeout.NoTimeout if timeout == "NoTimeout" else timeout)
