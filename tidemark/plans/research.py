"""Entry points: screen factors, test a signal, review a portfolio, compare strategies; results as dictionaries and as a page."""

from __future__ import annotations

import html
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import columns as C
from ..operators import engine, event, portfolio, recipes, sweeps
from ..operators.panel import Panel, forward, ret
from ..sources.ledger import dump_json, jsonable


#: What a figure has to be for its reading to be good: (name, figure, test, words). Thresholds are fixed values.
READINGS = (
    ("mean", "nw_t", lambda x: x >= 2.5, "Newey-West t of the mean return, from 2.5"),
    ("sharpe t", "sharpe_t", lambda x: x >= 3.0, "t of the Sharpe ratio, from 3"),
    ("win rate", "win_lo", lambda x: x > 0.5, "lower end of the win rate's interval, above one half"),
    ("kurtosis", "kurtosis", lambda x: x <= 5, "kurtosis, up to 5"),
    ("skew", "skew", lambda x: x >= -0.5, "skew, from -0.5"),
    ("bootstrap", "sharpe_lo", lambda x: x > 0, "lower end of the Sharpe ratio's interval, above 0"),
    ("permutation", "permutation_p", lambda x: x <= 0.05, "share of relabelled factors that do as well, up to 0.05"),
    ("deflated", "dsr_dsr", lambda x: x >= 0.95, "deflated Sharpe ratio, from 0.95"),
    ("overfitting", "pbo", lambda x: x < 0.3, "probability of overfitting, below 0.3"),
    ("relative fall", "max_relative_drawdown", lambda x: x > -0.3, "worst fall against the market, above -30 %"),
    ("styles", "style_alpha_t", lambda x: x >= 2.5, "t of what the styles leave, from 2.5"),
    ("names", "top_share", lambda x: x < 0.5, "share of the ten best names, below one half"),
    ("bars", "best_bars_share", lambda x: x < 0.5, "share of the five best bars, below one half"),
    ("kind history", "drawdown_p_worse", lambda x: x < 0.75, "share of resampled histories with a deeper fall, below 0.75"),
    ("years", "share_positive", lambda x: x >= 0.6, "share of years with a gain, from 0.6"),
    ("walk-forward", "walk_efficiency", lambda x: x >= 0.5, "out-of-sample over in-sample Sharpe ratio, from 0.5"),
    ("turnover", "turnover_daily", lambda x: x * 21 <= 1.0, "turnover of 21 bars, up to the whole book"),
    ("frozen date", "split_sharpe_ratio", lambda x: x >= 0.5, "Sharpe ratio after the date over that before, from 0.5"),
    ("event permutation", "permutation_p_win", lambda x: x <= 0.05, "share of moved signals that win as often, up to 0.05"),
    ("event excess", "excess_t", lambda x: x >= 2.5, "t of the day-level excess, from 2.5"),
)


@dataclass
class Result:
    """Tables, numbers and notes of an entry point. units: what the numbers of a name are in, where it is not plain."""

    kind: str
    tables: dict = field(default_factory=dict)
    numbers: dict = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    def rows(self, name: str) -> list[dict]:
        """A table on the driver; it is read once."""
        v = self.tables[name]
        if isinstance(v, DataFrame):
            v = self.tables[name] = [r.asDict() for r in v.collect()]
        return v

    def to_dict(self, series: str = "full") -> dict:
        """series: full, monthly (the net returns compounded by 21 bars) or none."""
        if series not in ("full", "monthly", "none"):
            raise ValueError("series is full, monthly or none")
        rows = {k: self.rows(k) for k in self.tables if k not in ("net", "rolling") or series != "none"}
        if series == "monthly" and "net" in rows:
            net = sorted(rows["net"], key=lambda r: r["t"])
            rows["net"] = [{"t": net[i]["t"], "net": math.prod(1 + (r["net"] or 0.0) for r in net[i : i + 21]) - 1} for i in range(0, len(net), 21)]
        units = {k: u for k in self.numbers for end, u in (("_bp", "basis points"), ("_annual", "share a year"), ("_t", "standard errors"), ("_p", "probability")) if k.endswith(end)}
        return jsonable({"numbers": self.numbers, "units": units, "tables": rows, "notes": self.notes})

    def to_json(self, series: str = "full") -> str:
        return dump_json(self.to_dict(series), self.kind)

    def readings(self) -> list[str]:
        """One sentence for each figure that has a threshold: whether it is met."""
        known = dict(self.numbers)
        if "market" in self.tables:
            known |= {"max_relative_drawdown": (self.rows("market") or [{}])[0].get("max_relative_drawdown")}
        if "years" in self.tables and (years := [r["ret"] for r in self.rows("years") if r.get("ret") is not None]):
            known["share_positive"] = sum(x > 0 for x in years) / len(years)
        if self.kind.startswith("event"):
            known["excess_t"] = known.get("t")
        out = []
        for name, figure, test, words in READINGS:
            x = known.get(figure)
            if isinstance(x, int | float) and math.isfinite(x):
                out.append(f"{name}: {'ok' if test(x) else 'weak'} ({words}; here {x:.3g})")
        return out

    def report(self, path: str) -> None:
        """One self-contained page: numbers, readings, the net value as a line, every table whole, and bars for the yearly returns."""
        d = self.to_dict()
        parts = [f"<h1>{html.escape(self.kind)}</h1>"]
        show = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else html.escape(str(x))
        parts.append("<table>" + "".join(f"<tr><th>{html.escape(k)}</th><td>{show(v)}</td></tr>" for k, v in d["numbers"].items()) + "</table>")
        parts.append("<ul>" + "".join(f"<li>{html.escape(x)}</li>" for x in self.readings()) + "</ul>")
        for name, rows in d["tables"].items():
            if name == "net" and rows:
                parts.append(_line([r["net"] or 0.0 for r in sorted(rows, key=lambda r: r["t"])]))
            elif name == "rolling" and rows:
                parts.append(f"<h2>{name}</h2>" + _points([r["sharpe"] for r in rows]))
            elif rows:
                if name == "years" and "ret" in rows[0]:
                    parts.append(_bars([(str(r["year"]), r["ret"] or 0.0) for r in rows]))
                head = "".join(f"<th>{html.escape(c)}</th>" for c in rows[0])
                parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{show(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>")
        parts += [f"<p>{html.escape(x)}</p>" for x in self.notes]
        Path(path).write_text("<!doctype html><meta charset=utf-8><style>body{font:14px sans-serif;margin:2em}td,th{padding:2px 8px;text-align:right}</style>" + "".join(parts), encoding="utf-8")


def _bars(values: list[tuple[str, float]], width: int = 720, height: int = 140) -> str:
    most = max((abs(v) for _, v in values), default=0) or 1
    step, middle = width / max(1, len(values)), height / 2
    out = []
    for i, (name, v) in enumerate(values):
        size = abs(v) / most * (middle - 14)
        out.append(f'<rect x="{i * step + 2:.1f}" y="{middle - size if v > 0 else middle:.1f}" width="{max(1, step - 4):.1f}" height="{size:.1f}" fill="{"#376" if v > 0 else "#944"}"/><text x="{i * step + 2:.1f}" y="{height - 1}" font-size="10">{html.escape(name)}</text>')
    return f'<svg width="{width}" height="{height}" role="img">{"".join(out)}</svg>'


def _points(values: list[float], width: int = 720, height: int = 120) -> str:
    known = [v for v in values if v is not None]
    lo, hi = min(known, default=0.0), max(known, default=1.0)
    at = " ".join(f"{width * i / max(1, len(values) - 1):.1f},{height * (1 - (v - lo) / ((hi - lo) or 1)):.1f}" for i, v in enumerate(values) if v is not None)
    return f'<svg width="{width}" height="{height}" role="img"><polyline fill="none" stroke="#246" points="{at}"/></svg>'


def _line(net: list[float], width: int = 720, height: int = 200) -> str:
    value, points = 1.0, [1.0]
    for x in net:
        value *= 1 + x
        points.append(value)
    lo, hi = min(points), max(points)
    at = lambda i, v: f"{width * i / max(1, len(points) - 1):.1f},{height * (1 - (v - lo) / ((hi - lo) or 1)):.1f}"
    return f'<svg width="{width}" height="{height}" role="img"><polyline fill="none" stroke="#246" points="{" ".join(at(i, v) for i, v in enumerate(points))}"/></svg>'


def _known(base: DataFrame, controls: list[str], notes: list[str], least: float = 0.5) -> list[str]:
    """Controls that are known for at least `least` of the eligible cells."""
    share = base.where("eligible").agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in controls)).first()
    notes += [f"{c} is known for {share[c] or 0:.0%} of eligible cells and left out" for c in controls if (share[c] or 0) < least]
    return [c for c in controls if (share[c] or 0) >= least]


def screen(p: Panel, factors: dict[str, Column], *, horizon: int = 5, cost_bp: float = 20.0, n_null: int = 20, seed: int = 0, gates: event.GateConfig | None = None, fire_q: float = 0.1, controls: list[str] | None = None, ledger=None, family: str = "screen") -> Result:
    """Many factors at once, each a key of the same jobs: regression t beside all controls against the null of the factor's own values shuffled within dates, rank correlation, decile profile, what buying the top fire_q earns, gates and the funnel of what passes. controls: names of `recipes.controls` to use instead of all; a date needs twice as many names as coefficients, and half of the median universe up to 50, with all of them known."""
    notes: list[str] = []
    lag, names = max(horizon, 21), sorted(factors)
    base = recipes.controls(p).join(forward(p, horizon).select("t", "ticker", "fwd"), ["t", "ticker"])
    controls = _known(base, controls or [c for c in base.columns if c.startswith("c_")], notes)
    half = base.groupBy("t").agg(F.count_if("eligible").alias("k")).agg(F.percentile("k", 0.5)).first()[0] * 0.5
    least = int(max(2 * (len(controls) + 2), min(50, half)))
    df = C.stacked(p.df.withColumn("ret1", ret(1)), "name", "factor", {n: factors[n] for n in names}, "t", "ticker")
    x = df.join(base.select("t", "date", "ticker", "eligible", "fwd", *controls), ["t", "ticker"])
    key = ("name",)
    fm = stats.fama_macbeth(x, "fwd", "factor", controls, least, key).persist()
    t = {r["name"]: r for r in stats.newey_west(fm, "beta", lag, key).collect()}
    t_raw = {r["name"]: r["t"] for r in stats.newey_west(fm, "raw", lag, key).collect()}
    lost = {r["name"]: r["c"] or 0.0 for r in fm.groupBy("name").agg(F.avg(F.col("collinear").cast("double")).alias("c")).collect()}
    fm.unpersist()
    drawn = x.where("eligible AND factor IS NOT NULL").withColumn("_id", F.concat_ws("\x01", "name", F.col("t").cast("string")))
    reps = p.df.sparkSession.range(n_null).withColumnRenamed("id", "rep")
    w = Window.partitionBy("rep", "_id")
    a = drawn.crossJoin(F.broadcast(reps)).withColumn("k", F.row_number().over(w.orderBy("ticker"))).withColumn("j", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "rep", "_id", "ticker"), "ticker")))
    shuffled = a.select("rep", "_id", "name", "t", "k", "eligible", "fwd", *controls).join(a.select("rep", "_id", F.col("j").alias("k"), F.col("factor").alias("value")), ["rep", "_id", "k"])
    null = stats.newey_west(stats.fama_macbeth(shuffled, "fwd", "value", controls, least, ("name", "rep")), "beta", lag, ("name", "rep")).groupBy("name").agg(F.percentile(F.abs("t"), 0.95).alias("q"))
    null = {r["name"]: r["q"] for r in null.collect()}
    ic = {r["name"]: r for r in event.ic_report(event.ic_daily(x, keys=key), lag=horizon, keys=key).collect()}
    profile = event.decile_profile(x, keys=key)
    shape = {r["name"]: r for r in event.profile_shape(profile, keys=key).collect()}
    fired = x.withColumn("_r", C.pct_rank("factor", "eligible", ("name", "t"))).select("name", "t", "date", "ticker", "eligible", F.coalesce(F.col("_r") >= F.lit(1 - fire_q), F.lit(False)).alias("fire"), F.col("fwd").alias("cum"))
    excess = event.daily_excess(fired, key).join(p.df.select("t", "date").distinct(), "t").persist()
    deployed = {r["name"]: r for r in stats.newey_west(excess, "excess", lag, key, least=100).collect()}
    halves = {}
    ranked = excess.withColumn("half", F.when(F.row_number().over(Window.partitionBy("name").orderBy("t")) <= F.floor(F.count("*").over(Window.partitionBy("name")) / 2), 1).otherwise(2))
    for r in ranked.groupBy("name", "half").agg(F.avg("excess").alias("m")).orderBy("half").collect():
        halves.setdefault(r["name"], []).append(r["m"])
    years: dict = {}
    for r in excess.groupBy("name", F.year("date").alias("y")).agg(F.avg("excess").alias("m"), F.count("*").alias("n")).where("n >= 40").collect():
        years.setdefault(r["name"], []).append(r["m"])
    excess.unpersist()
    rows, cfg = [], gates or event.GateConfig()
    for n in names:
        if n not in t or t[n]["t"] is None:
            notes.append(f"{n}: fewer than 30 dates have {least} names with the factor, a return and all {len(controls)} controls, so it has no t")
        if lost.get(n, 0) > 0.5:
            notes.append(f"{n} is almost a combination of the controls: nothing is left of it on {lost[n]:.0%} of the days")
        threshold = null.get(n) if cfg.null_threshold is None else cfg.null_threshold
        d, s = deployed.get(n), shape.get(n)
        net = None if d is None or d["mean"] is None else d["mean"] * 1e4 - cost_bp
        verdict = event.run_gates(t[n]["t"] if n in t else None, net, s["rho"] if s else None, halves.get(n, []), years.get(n, []), None, replace(cfg, null_threshold=threshold))
        rows.append({
            "factor": n, "t": t[n]["t"] if n in t else None, "t_raw": t_raw.get(n), "coef_bp": t[n]["mean"] * 1e4 if n in t and t[n]["mean"] is not None else None, "null_p95": null.get(n), "passes": verdict["gates"]["G1 threshold"], "ic": ic[n]["mean"] if n in ic else None, "icir": ic[n]["icir"] if n in ic else None,
            "ic_t": ic[n]["t"] if n in ic else None, "rho": s["rho"] if s else None, "top_minus_bottom_bp": s["spread_bp"] if s else None, "excess_t": d["t"] if d else None, "net_bp": net, "all_gates": verdict["passed"], "first_failure": verdict["first_failure"],
        })
    rows.sort(key=lambda r: (r["net_bp"] is None, -(r["net_bp"] or 0), r["factor"]))
    funnel = {"factors": len(rows), "passed": sum(r["passes"] for r in rows), "net_positive": sum(r["passes"] and (r["net_bp"] or 0) > 0 for r in rows), "all_gates": sum(r["all_gates"] for r in rows)}
    if ledger is not None:
        for r in rows:
            ledger.record(family, r["factor"], {"factor": r["factor"], "horizon": horizon, "cost_bp": cost_bp}, excess.where(F.col("name") == r["factor"]).select("date", F.col("excess").alias("ret")))
    return Result("screen", {"summary": rows, "deciles": profile.orderBy("name", "bin")}, funnel, notes)


def backtest_event(p: Panel, fire: Column, *, horizons: tuple[int, ...] = (1, 2, 5, 10, 21), primary: int | None = None, cost_bp: float = 20.0, delist_return: float | None = None, neutralize: bool = True, gates: event.GateConfig | None = None, ledger=None, family: str = "event", name: str | None = None) -> Result:
    """Trade statistics of each horizon, and the verdict of the primary one (else of the one with the largest lift, a choice on the same sample): day-level excess with Newey-West, profile, structure, what is left beside the controls, gates."""
    if not horizons or any(isinstance(h, bool) or not isinstance(h, int) or h < 1 for h in horizons) or not 0 <= cost_bp < float("inf") or primary is not None and primary not in horizons:
        raise ValueError("horizons are whole numbers of at least 1, one of them is primary, and cost_bp is not negative")
    notes: list[str] = []
    fired = p.df.withColumn("ret1", ret(1)).select("t", "date", "ticker", "eligible", (F.coalesce(fire, F.lit(False)) & F.col("eligible")).alias("fire"))
    outcome = None
    for h in horizons:
        f = forward(p, h, delist_return).select(F.lit(h).alias("horizon"), "t", "ticker", F.col("fwd").alias("cum"))
        outcome = f if outcome is None else outcome.unionByName(f)
    x = fired.join(outcome, ["t", "ticker"])
    key = ("horizon",)
    trades = {r["horizon"]: r.asDict() for r in event.trade_stats(x, cost_bp, keys=key).collect() if r["win"] is not None}
    if not trades:
        raise ValueError("no horizon has 100 trades")
    excess = event.daily_excess(x, key)
    for h in trades:
        w = stats.newey_west(excess.where(F.col("horizon") == h), "excess", max(h, 21)).first()
        trades[h] |= {"excess_bp": None if w["mean"] is None else w["mean"] * 1e4, "t": w["t"], "days": w["n"], "net_bp": None if w["mean"] is None else w["mean"] * 1e4 - cost_bp}
    if primary is not None and primary not in trades:
        raise ValueError(f"the horizon {primary} has fewer than 100 trades")
    best = primary or max(trades, key=lambda h: (trades[h]["lift"] if trades[h]["lift"] is not None else -99.0, -h))
    if primary is None and len(trades) > 1:
        notes.append(f"the horizon {best} was chosen as the best of {len(trades)} on the same sample; its figures are optimistic")
    one = trades[best]
    if one["days"] < 100:
        notes.append(f"only {one['days']} days of excess returns: the gates cannot be trusted")
    lag = max(best, 21)
    daily = excess.where(F.col("horizon") == best).join(p.df.select("t", "date").distinct(), "t")
    structure = event.fire_structure(fired).first().asDict()
    profile = event.decile_profile(fired.withColumn("factor", F.col("fire").cast("double")).join(outcome.where(F.col("horizon") == best).select("t", "ticker", F.col("cum").alias("fwd")), ["t", "ticker"]))
    shape = event.profile_shape(profile).first()
    halves = [r["mean"] for r in event.subperiod(daily, "excess", lag).orderBy("half").collect()]
    years = [r["mean"] for r in event.yearly(daily, "excess").collect()]
    left = None
    if neutralize:
        base = recipes.controls(p)
        controls = _known(base, [c for c in base.columns if c.startswith("c_")], notes)
        b = event.dummy_neutralized(x.where(F.col("horizon").isin(list(trades))).join(base.select("t", "ticker", *controls), ["t", "ticker"]), controls, key)
        left = {r["horizon"]: r.asDict() for r in event.neutral_survival(b, lag, key).collect()}
    survival = left[best]["survival"] * 100 if left and best in left and left[best]["survival"] is not None else None
    verdict = event.run_gates(one["t"], one["net_bp"], shape["rho"] if shape else None, halves, years, structure, gates or event.GateConfig(), survival)
    if ledger is not None:
        ledger.record(family, name or "event", {"kind": "event", "horizons": list(horizons), "primary": primary, "best": best, "cost_bp": cost_bp, "delist_return": delist_return}, daily.select("date", F.col("excess").alias("ret")))
    look = sweeps.assert_no_lookahead(p, F.coalesce(fire, F.lit(False)), max(horizons))
    numbers = {"horizon": best, "t": one["t"], "excess_bp": one["excess_bp"], "net_bp": one["net_bp"], "rho": shape["rho"] if shape else None, "passed": verdict["passed"], "first_failure": verdict["first_failure"], "lookahead_pass": look["pass"]}
    tables = {"horizons": [trades[h] for h in sorted(trades)], "gates": [{"gate": k, "pass": v} for k, v in verdict["gates"].items()], "structure": [structure], "holdout": event.holdout(daily, "excess"), "deciles": profile.orderBy("bin")}
    if left is not None:
        tables["neutral"] = [left[h] for h in sorted(left)]
    return Result("event", tables, numbers, notes)


def review_event(
    p: Panel, fire: Column, *, horizons: tuple[int, ...] = (1, 5, 20), cost_bp: float = 20.0, cost_grid=(0.0, 5.0, 10.0, 20.0, 40.0, 80.0), n_permutations: int = 200, as_portfolio: bool = True, hold: int | None = None, seed: int = 0, delist_return: float | None = None, **settings,
) -> Result:
    """An event with every test: win rates with intervals by horizon and year, costs at which it becomes a coin toss, losing streak, day-level excess, thirds by liquidity and size, copies moved in time, and the event held as a portfolio."""
    res = backtest_event(p, fire, horizons=horizons, cost_bp=cost_bp, delist_return=delist_return, **settings)
    h = res.numbers["horizon"]
    df = forward(p, h, delist_return).withColumn("ret1", ret(1)).withColumn("cum", F.col("fwd"))
    df = df.withColumn("fire", F.coalesce(fire, F.lit(False)) & F.col("eligible"))
    value = {"liquidity": C.rolling(F.avg, F.col("close") * F.col("volume"), 30)} if p.has("volume") else {}
    if p.has("mkt_cap"):
        value["size"] = F.when(F.col("mkt_cap") > 0, F.col("mkt_cap"))
    for k, v in value.items():
        df = df.withColumn(f"_{k}", v).withColumn(f"seg_{k}", event.terciles(f"_{k}"))
    df = df.persist()
    trades = df.where("fire AND cum IS NOT NULL").withColumn("r", F.col("cum") - cost_bp / 1e4)
    interval = lambda rows: [r | dict(zip(("win_lo", "win_hi"), stats.wilson_interval(r.pop("up"), r["n"]), strict=True)) for r in rows]
    counted = [F.count("*").alias("n"), F.count_if(F.col("r") > 0).alias("up"), F.avg((F.col("r") > 0).cast("double")).alias("win"), F.avg("r").alias("mean"), F.percentile("r", 0.5).alias("median")]
    years = [r.asDict() for r in trades.groupBy(F.year("date").alias("year")).agg(*counted).orderBy("year").collect()]
    costs_ = df.crossJoin(F.broadcast(p.df.sparkSession.createDataFrame([(float(c),) for c in cost_grid], "cost_bp double")))
    costs_ = costs_.withColumn("cum", F.col("cum") - F.col("cost_bp") / 1e4)
    table = [r.asDict() for r in event.trade_stats(costs_, 0.0, least=1, keys=("cost_bp",)).select("cost_bp", "n", "win", "base", "lift", "mean", "median").orderBy("cost_bp").collect()]
    streak = C.run_length(trades.groupBy("t").agg(F.avg("r").alias("m")).withColumn("_k", F.lit(0)).withColumn("_l", F.col("m") <= 0).withColumn("d", F.row_number().over(Window.orderBy("t"))), "_l", "run", key="_k", order="d").agg(F.max("run")).first()[0]
    segments = {k: interval([r.asDict() for r in trades.where(F.col(f"seg_{k}") >= 0).groupBy(F.col(f"seg_{k}").alias("third")).agg(*counted).where("n >= 20").orderBy("third").collect()]) for k in value}
    numbers, notes = dict(res.numbers) | {"longest_losing_streak_days": streak}, list(res.notes)
    w = stats.newey_west(event.daily_excess(df), "excess", max(h, 21)).first()
    numbers["excess_p"] = None if w["t"] is None else stats.two_sided(w["t"])
    tables = dict(res.tables) | {"horizons": interval([r | {"up": round(r["win"] * r["n"])} for r in res.tables["horizons"]]), "costs": table, "years": interval(years)} | {f"by_{k}": v for k, v in segments.items()}
    if n_permutations:
        try:
            reps = sweeps.signal_permutation(p, fire, h, cost_bp, n=n_permutations, delist_return=delist_return, seed=seed).persist()
            numbers |= {"permutation_p_win": sweeps.null_summary(reps, "win")["p"], "permutation_p_mean": sweeps.null_summary(reps, "mean")["p"]}
            reps.unpersist()
        except ValueError as e:
            notes.append(f"permutation test not computed: {e}")
    if as_portfolio:
        k = hold or h
        lots = df.withColumn("_w", F.coalesce(portfolio.event_weights("fire", k), F.lit(0.0))).select("date", "ticker", F.sum("_w").over(C.back(k)).alias("w"))
        run = engine.backtest_weights(p, lots, spread_bp=cost_bp, check_universe=False, check_shortable=False, delist_return=delist_return)
        numbers |= {f"portfolio_{c}": v for c, v in run.metrics().items() if c in ("cagr", "sharpe", "mdd", "turnover_daily")}
        tables |= {"net": run.daily.select("t", "net").orderBy("t"), "market": stats.market_relative(run.daily, p.periods_per_year)}
    df.unpersist()
    out = Result("event review", tables, numbers, notes)
    out.notes += out.readings()
    return out


def settings_grid(grid: dict[str, list]) -> list[dict]:
    """Every combination, numbers in ascending order, so that neighbours in the list are neighbours in value."""
    out = [{}]
    for k, values in grid.items():
        values = sorted(values) if all(isinstance(v, int | float) and not isinstance(v, bool) for v in values) else list(values)
        out = [c | {k: v} for c in out for v in values]
    return out


def review_portfolio(
    p: Panel, factor: Column, *, make_factor: Callable[..., Column] | None = None, grid: dict[str, list] | None = None, long_q: float = 0.2, short_q: float | None = 0.2, hold: int = 4, cost_bp: float = 10.0, holds=(1, 4, 8), cost_grid=(0.0, 10.0, 20.0),
    walk: tuple[int, int] | None = None, n_bootstrap: int = 500, n_permutations: int = 50, extra_factors: DataFrame | None = None, groups: DataFrame | None = None, benchmark_returns: DataFrame | None = None, split_date=None, stress=(0.0, -0.3, -0.5, -1.0), ledger=None, family: str = "review", extra_trials: int = 0,
    seed: int = 0, **engine_settings,
) -> Result:
    """One factor portfolio with every test: result and costs, settings, walk-forward and overfitting over them, inference, market, risk, styles, attribution, permutation, delisting stress.

    make_factor(**setting) with grid tries other factors as well as holds. walk: training and test bars. extra_factors: t and columns; groups: (ticker, grp);
    benchmark_returns: daily (date, ret) of an index. engine_settings go to the engine (rates, funding, freeze, impact).
    """
    notes: list[str] = []
    run = engine.backtest_portfolio(p, factor, long_q=long_q, short_q=short_q, hold=hold, spread_bp=cost_bp, benchmark="equal", grid=False, ledger=ledger, family=family, **engine_settings)
    notes += run.notes
    net = run.daily.persist()
    book = run.positions
    k = p.periods_per_year
    df = portfolio.one_bar(p).withColumn("ret1", ret(1)).withColumn("factor", factor)
    trials = portfolio.grid(p, "factor", tuple(holds), tuple(cost_grid), long_q, short_q, df).select(F.concat(F.lit("hold="), "hold", F.lit(" cost="), "cost_bp").alias("trial"), "t", F.col("net").alias("ret"), "hold", "cost_bp")
    if make_factor is not None and grid:
        configs = settings_grid(grid)
        x = C.stacked(portfolio.one_bar(p).withColumn("ret1", ret(1)), "trial", "f", {json.dumps(c, sort_keys=True): make_factor(**c) for c in configs}, "t", "ticker", "eligible", "fwd1")
        h = sweeps.keyed_holdings(x, "trial", "f", long_q, short_q, hold)
        d = h.withColumn("_d", F.abs(F.coalesce(F.col("h") - F.lag("h").over(Window.partitionBy("trial", "ticker").orderBy("t")), F.lit(0.0)))).groupBy("trial", "t").agg((F.sum(F.col("h") * F.col("fwd1")) - F.sum("_d") * cost_bp / 2e4).alias("ret"))
        end = p.df.agg(F.max("t").alias("_e"))
        d = d.crossJoin(F.broadcast(end)).where(F.col("t") < F.col("_e") - p.entry_lag).drop("_e")
        trials = trials.unionByName(d, allowMissingColumns=True)
    trials = trials.persist()
    m, mean = run.metrics(), stats.mean_report(net, k)
    numbers = {**m, **{c: mean[c] for c in ("nw_t", "nw_p", "sharpe_t", "win_rate", "win_lo", "win_hi", "sign_p", "skew", "kurtosis")}}
    numbers["t"] = mean["nw_t"]
    boot = stats.sharpe_ci(net, k, n_bootstrap, seed=seed)
    numbers |= {"sharpe_lo": boot["lo"], "sharpe_hi": boot["hi"]}
    n_trials = trials.select("trial").distinct().count()
    numbers |= {f"dsr_{c}": v for c, v in stats.deflated_sharpe(trials, n_trials + extra_trials).items()}
    bars = net.count()
    if bars >= 64:
        numbers["pbo"] = stats.pbo(trials.select("trial", "t", "ret"), 8 if bars < 320 else 16, 2000)
    train, test = walk or (bars // 3, max(10, bars // 12))
    try:
        folds = stats.walk_forward(trials.select("trial", "t", "ret"), train, test, embargo=hold + p.entry_lag).persist()
        w = stats.walk_forward_summary(trials, folds, k, train)
        folds.unpersist()
        numbers |= {f"walk_{c}": w[c] for c in ("oos_sharpe", "mean_is_sharpe", "efficiency", "share_folds_positive")}
    except ValueError as e:
        notes.append(f"walk-forward not computed: {e}")
    if n_permutations >= 10:
        perm = sweeps.null_summary(sweeps.factor_permutation(p, factor, n_permutations, seed=seed, long_q=long_q, short_q=short_q, hold=hold))
        numbers |= {"permutation_p": perm["p"], "null_p95_sharpe": perm["null_p95"]}
    fall = stats.drawdown_distribution(net, max(100, n_bootstrap), seed=seed) if bars >= 60 else None
    if fall:
        numbers |= {f"drawdown_{c}": v for c, v in fall.items() if c != "n"}
        numbers |= stats.filtered_risk(net, k)
    numbers["breakeven_bp"] = sweeps.breakeven_bp(net, cost_bp).first()[0] if cost_bp else None
    if split_date is not None:
        io = stats.in_out_of_sample(net, split_date, k)
        numbers |= {"split_sharpe_ratio": io["sharpe_ratio"], "split_mean_diff_t": io["mean_diff_t"], "split_oos_sharpe": io["out_of_sample"]["sharpe"]}
    styles = sweeps.style_returns(p, hold)
    if extra_factors is not None:
        styles = styles.join(extra_factors, "t", "left")
    frame = styles.join(net.select("t", "net"), "t").toPandas()
    names = [c for c in frame.columns if c not in ("t", "net") and frame[c].notna().sum() > 60 and frame[c].std() > 1e-12]
    try:
        own = stats.decompose(frame, "net", names, periods=k)
        numbers |= {"style_alpha_t": own["alpha_t"], "style_alpha_annual": own["alpha_annual"], "unexplained_share": own["unexplained_share"], "appraisal": own["appraisal"]}
    except ValueError as e:
        own = None
        notes.append(str(e))
    both = net if benchmark_returns is None else net.drop("bench").join(engine.align_benchmark(p, benchmark_returns), "t")
    cells = trials.where("hold IS NOT NULL").groupBy("hold", "cost_bp").agg((C.div(F.avg("ret"), F.stddev_samp("ret")) * k**0.5).alias("sharpe"))
    i, j = {h: n for n, h in enumerate(sorted(holds))}, {c: n for n, c in enumerate(sorted(cost_grid))}
    at = lambda c, place: F.coalesce(*(F.when(F.col(c) == v, n) for v, n in place.items()))
    years = stats.subperiods(net, k).orderBy("year")
    conc = event.concentration(book).first().asDict()
    numbers |= {"top_share": conc["top_share"], "best_bars_share": conc["best_share"]}
    tables = {
        "net": net.select("t", "net").orderBy("t"), "grid": cells.orderBy("hold", "cost_bp"), "plateau": stats.plateau(cells.select(at("hold", i).alias("i"), at("cost_bp", j).alias("j"), F.col("sharpe").alias("value"))), "market": stats.market_relative(both, k), "risk": stats.risk_profile(net, k), "years": years,
        "halves": stats.halves(net, k).orderBy("half"), "regimes": stats.regimes(both, window=26 if k < 100 else 60, periods=k), "rolling": stats.rolling_sharpe(net, max(20, k // 2), k).where("sharpe IS NOT NULL").orderBy("t"),
        "names": event.attribution(book, "ticker").orderBy(F.desc("contribution"), "ticker").limit(10), "worst_names": event.attribution(book, "ticker").orderBy("contribution", "ticker").limit(10), "concentration": [conc], "holdings": event.holdings_summary(book, k),
        "waterfall": [{"part": c, "bp": m[f"{c}_annual_bp"]} for c in ("spread", "side", "borrow", "impact", "funding", "mark")],
    }
    if own:
        tables["styles"] = [{"factor": c, "beta": own["beta"][c], "t": own["t"][c], "contribution_annual": own["contribution_annual"][c]} for c in names]
    for c in ("mkt_cap", "volume"):
        if p.has(c):
            v = F.when(F.col("mkt_cap") > 0, F.col("mkt_cap")) if c == "mkt_cap" else C.rolling(F.avg, F.col("close") * F.col("volume"), 30)
            tables[{"mkt_cap": "by_size", "volume": "by_liquidity"}[c]] = event.attribution(book.withColumn("_v", v).withColumn("third", event.terciles("_v")), "third").orderBy("third")
    if groups is not None:
        tables["by_group"] = event.attribution(book.join(groups.select("ticker", "grp"), "ticker", "left"), "grp").orderBy("grp")
    if p.has("delist_after"):
        rows = []
        for x in stress:
            s = engine.backtest_portfolio(p, factor, long_q=long_q, short_q=short_q, hold=hold, spread_bp=cost_bp, benchmark=None, grid=False, delist_return=x, **{c: v for c, v in engine_settings.items() if c != "delist_return"}).metrics()
            rows.append({"delist_return": x, "cagr": s["cagr"], "sharpe": s["sharpe"], "mdd": s["mdd"]})
        tables["delisting"] = rows
    out = Result("portfolio", tables, numbers, notes)
    out.notes += out.readings()
    return out


def compare(parts: dict[str, DataFrame], periods: int) -> Result:
    """Up to six daily tables (t, net) side by side on their shared dates."""
    if not 2 <= len(parts) <= 6:
        raise ValueError("from two to six strategies")
    x = None
    for name, d in parts.items():
        y = d.select(F.lit(name).alias("name"), "t", "net").where("net IS NOT NULL")
        x = y if x is None else x.unionByName(y)
    shared = x.groupBy("t").agg(F.countDistinct("name").alias("k")).where(F.col("k") == len(parts)).select("t")
    x = x.join(shared, "t")
    y = x.select(F.col("name").alias("other"), "t", F.col("net").alias("net2"))
    return Result("compare", {"metrics": stats.metrics(x, periods, ("name",)).orderBy("name"), "correlation": x.join(y, "t").where("name < other").groupBy("name", "other").agg(F.corr("net", "net2").alias("corr")).orderBy("name", "other")})
