"""Bar sources: exchange kline files, minute bars, funding settlements, exchange rules."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KLINE = "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trades long"


def read_kline_zips(spark: SparkSession, path: str) -> DataFrame:
    """symbol-file path and kline rows of all zipped CSV files below path; a header line is left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in KLINE.split(", ")]
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        x = pd.read_csv(io.BytesIO(z.read(member)), header=None, names=range(12), dtype=str)
                        x = x[x[0].str.isdigit()].iloc[:, :9]
                        x.columns = names
                        x = x.astype({n: ("int64" if "time" in n or n == "trades" else "float64") for n in names})
                        x.insert(0, "path", name)
                        yield x

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, f"path string, {KLINE}")


def instant(epoch: str) -> F.Column:
    """Milliseconds or microseconds since 1970, told apart by their size."""
    x = F.col(epoch)
    return F.timestamp_micros(F.when(x > 10**14, x).otherwise(x * 1000))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last by order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def bar_minutes(bar: str) -> int:
    n = int(bar[:-1]) * {"m": 1, "h": 60, "d": 1440}[bar[-1]]
    if n < 1 or 1440 % n:
        raise ValueError(f"{bar} does not divide a day")
    return n


def aggregate_bars(minutes: DataFrame, bar: str, by: str = "symbol") -> DataFrame:
    """Bars labelled by their end from one-minute rows (symbol, ts at the minute's start, o, h, l, c, volume). Works on batches and on streams with a watermark on ts."""
    more = [c for c in ("quote_volume", "trades") if c in minutes.columns]
    g = minutes.groupBy(by, F.window("ts", f"{bar_minutes(bar)} minutes").alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_min"), *(F.sum(c).alias(c) for c in more)
    )
    return g.select(by, F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume", "n_min", *more)


def drop_partial(bars: DataFrame, minutes: DataFrame, by: str = "symbol") -> DataFrame:
    """Batch: without the last bar where the minutes end before it."""
    end = minutes.agg((F.max("ts") + F.expr("INTERVAL 1 MINUTE")).alias("_e"))
    return bars.crossJoin(F.broadcast(end)).where("bar_end <= _e").drop("_e")


def funding_to_bars(settlements: DataFrame, minutes: int) -> DataFrame:
    """symbol, bar_end, rate: settlements rounded to the minute, summed on the first bar that ends at or after them."""
    s = F.round(F.unix_micros("ts") / 60_000_000) * 60
    end = F.ceil(s / (minutes * 60)) * (minutes * 60)
    return settlements.groupBy("symbol", F.timestamp_seconds(end).alias("bar_end")).agg(F.sum("rate").alias("rate"))


def next_day_eligibility(daily: DataFrame, bars: DataFrame) -> DataFrame:
    """bars with eligible: whether the symbol was fit on the day before the bar's own day."""
    day = F.to_date(F.col("bar_end") - F.expr("INTERVAL 1 MINUTE"))
    ok = daily.select("symbol", F.date_add("day", 1).alias("_day"), F.col("ok").alias("_ok"))
    return bars.withColumn("_day", day).join(ok, ["symbol", "_day"], "left").withColumn("eligible", F.coalesce("_ok", F.lit(False))).drop("_day", "_ok")


def symbol_rules(info: DataFrame) -> DataFrame:
    """symbol, lot, min_notional, tick from exchange information (symbols: array of structs with filters)."""
    s = info.select(F.explode("symbols").alias("s")).select("s.symbol", F.explode("s.filters").alias("f"))
    pick = lambda kind, field: F.max(F.when(F.col("f.filterType") == kind, F.col(f"f.{field}").cast("double")))
    r = s.groupBy("symbol").agg(pick("LOT_SIZE", "stepSize").alias("step"), pick("LOT_SIZE", "minQty").alias("min_qty"), pick("MIN_NOTIONAL", "notional").alias("min_notional"), pick("PRICE_FILTER", "tickSize").alias("tick"))
    return r.where("step IS NOT NULL").select("symbol", F.greatest("step", "min_qty").alias("lot"), "min_notional", "tick")


def execution_rules(rules: DataFrame, tickers: DataFrame, missing: str = "raise") -> DataFrame:
    """ticker, lot, min_notional of each ticker by exchange rules (`symbol_rules`). missing: "raise" for tickers without rules, or "null"."""
    if missing not in ("raise", "null"):
        raise ValueError("missing is raise or null")
    want = tickers.select("ticker").distinct()
    unknown = [r[0] for r in want.join(rules.select(F.col("symbol").alias("ticker")), "ticker", "left_anti").orderBy("ticker").limit(5).collect()]
    if unknown and missing == "raise":
        raise ValueError(f"no rules for {', '.join(unknown)}")
    return want.join(rules.select(F.col("symbol").alias("ticker"), "lot", "min_notional"), "ticker", "left")


def top_up(archive: DataFrame, live: DataFrame, today, key: str = "symbol") -> DataFrame:
    """Daily rows (key, date, ...) of an archive with newer rows from a live source: the live row wins on the same day, and the unfinished bar of today goes."""
    both = archive.withColumn("_live", F.lit(0)).unionByName(live.withColumn("_live", F.lit(1)), allowMissingColumns=True).where(F.col("date") < F.lit(today))
    return keep_last(both, [key, "date"], "_live").drop("_live")


def daily_funding(settlements: DataFrame) -> DataFrame:
    """symbol, date, rate: settlements (symbol, ts, rate) summed by UTC day."""
    return settlements.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.sum("rate").alias("rate"))


def read_funding_zips(spark: SparkSession, path: str) -> DataFrame:
    """path, ts, rate of zipped CSV files of funding settlements (calc_time, interval, rate); a header line is left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        x = pd.read_csv(io.BytesIO(z.read(member)), header=None, names=range(3), dtype=str)
                        x = x[x[0].str.strip().str.isdigit().fillna(False)]
                        yield pd.DataFrame({"path": name, "time": x[0].astype("int64"), "rate": x[2].astype("float64")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, time long, rate double").select("path", instant("time").alias("ts"), "rate")


def archive_paths(root: str, symbol: str, start, end, today) -> list[str]:
    """Files that cover [start, end): one for each whole past month, and one a day for the month of `today`."""
    import datetime as dt

    out, day = [], dt.date(start.year, start.month, 1)
    last = end - dt.timedelta(days=1)
    while day <= last:
        after = (day.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        if (day.year, day.month) < (today.year, today.month):
            out.append(f"{root}/monthly/{symbol}/{symbol}-{day:%Y-%m}.zip")
        else:
            d = max(day, dt.date(start.year, start.month, start.day))
            while d < min(after, end, today):
                out.append(f"{root}/daily/{symbol}/{symbol}-{d:%Y-%m-%d}.zip")
                d += dt.timedelta(days=1)
        day = after
    return out


def between(minutes: DataFrame, start, end, at: str = "bar_end") -> DataFrame:
    """Rows of the half-open time (start, end]: bars are known by their end."""
    return minutes.where((F.col(at) > F.lit(start)) & (F.col(at) <= F.lit(end)))


def minute_bars(klines: DataFrame, symbol: str = "symbol") -> DataFrame:
    """symbol, bar_end, open .. trades of kline rows (symbol, open_time in ms or us, ...): labelled by their end, rows without close left out, the last of repeated minutes kept."""
    x = klines.where("close IS NOT NULL").withColumn("bar_end", instant("open_time") + F.expr("INTERVAL 1 MINUTE"))
    return keep_last(x, [symbol, "bar_end"], "open_time").select(symbol, "bar_end", "open", "high", "low", "close", "volume", "quote_volume", "trades")


def estimate_memory(n_bars: int, n_symbols: int, n_matrices: int = 20) -> float:
    """GB of that many float64 matrices; advice only, since Spark spills."""
    return n_bars * n_symbols * n_matrices * 8 / 1e9
