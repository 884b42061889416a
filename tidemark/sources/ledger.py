"""Append-only trial ledger with chained hashes, and JSON export of results."""

from __future__ import annotations

import contextlib
import datetime as dt
import fcntl
import hashlib
import json
import math
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonable(x):
    """Plain JSON values: NaN and infinities become null, sets are sorted; keys that are equal as text are refused."""
    if isinstance(x, dict):
        keys = [str(k) for k in x]
        if len(set(keys)) < len(keys):
            raise ValueError("two keys are the same text")
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return sorted(map(jsonable, x), key=str)
    if isinstance(x, (list, tuple)):
        return [jsonable(v) for v in x]
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    return x if x is None or isinstance(x, (bool, int, str)) else jsonable(x.item()) if hasattr(x, "item") else str(x)


def dump_json(x, kind: str) -> str:
    return json.dumps({"schema_version": 1, "kind": kind} | jsonable(x), ensure_ascii=False, sort_keys=True, allow_nan=False)


def array_fingerprint(df: DataFrame, *columns: str) -> str:
    """16 hex digits of the values of a table as single-precision numbers; the order of its rows and partitions does not count."""
    kinds = dict(df.dtypes)
    cells = [F.col(c).cast("float") if kinds[c] in ("double", "float") else F.col(c) for c in columns or df.columns]
    n, a, b = df.agg(F.count("*"), F.bit_xor(F.xxhash64(*cells)), F.sum(F.xxhash64(F.lit(1), *cells).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{len(cells)}|{n}|{a}|{b}".encode()).hexdigest()[:16]


class Ledger:
    """Lines on the driver; each trial's return series is one Parquet folder, which Spark reads back."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.path.mkdir(parents=True, exist_ok=True)
        self.lines = self.path / "trials.jsonl"

    def rows(self) -> list[dict]:
        return [json.loads(x) for x in self.lines.read_text().splitlines()] if self.lines.exists() else []

    @staticmethod
    def _hash(row: dict) -> str:
        return hashlib.sha256(json.dumps({k: v for k, v in row.items() if k != "row_hash"}, sort_keys=True).encode()).hexdigest()

    def record(self, family: str, name: str, config: dict, returns: DataFrame) -> str:
        """returns: date, ret. A configuration that is known already is written once more as a line, but counts once."""
        config = jsonable(config)
        key = hashlib.sha256(json.dumps([family, config], sort_keys=True).encode()).hexdigest()[:16]
        returns.select("date", F.col("ret").cast("double")).write.mode("overwrite").parquet(f"{self.path}/returns/{key}")
        n, mean, std = returns.agg(F.count("ret"), F.avg("ret"), F.stddev_samp("ret")).first()
        with self._locked():
            return self._append(family, name, key, config, n, mean / std if std else None)

    @contextlib.contextmanager
    def _locked(self) -> Iterator[None]:
        """One writer at a time reads the end of the chain and adds to it."""
        with (self.path / "lock").open("w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            try:
                yield
            finally:
                fcntl.flock(f, fcntl.LOCK_UN)

    def _append(self, family: str, name: str, key: str, config: dict, n: int, sharpe: float | None) -> str:
        old = self.rows()
        row = {"t": dt.datetime.now(dt.timezone.utc).isoformat(), "family": family, "name": name, "config_hash": key, "config": config, "n_obs": n, "sharpe": sharpe, "prev": old[-1]["row_hash"] if old else ""}
        row["row_hash"] = self._hash(row)
        with self.lines.open("a") as f:
            f.write(json.dumps(row, sort_keys=True) + "\n")
        return key

    def verify(self) -> bool:
        prev = ""
        for row in self.rows():
            if row["prev"] != prev or row["row_hash"] != self._hash(row):
                return False
            prev = row["row_hash"]
        return True

    def trials(self, family: str | None = None) -> list[dict]:
        seen: dict[tuple, dict] = {}
        for r in self.rows():
            if family in (None, r["family"]):
                seen.setdefault((r["family"], r["config_hash"]), r)
        return list(seen.values())

    def deflated_sharpe(self, spark: SparkSession, reference: str | None = None) -> dict:
        """Of the best trial (or the one with the config hash `reference`) among all that were recorded."""
        from ..functions.stats import deflated_sharpe

        return deflated_sharpe(self.returns(spark), len(self.trials()), reference)

    def returns(self, spark: SparkSession, least: int = 30) -> DataFrame:
        """trial, t, ret on the dates that all trials share."""
        out, k = None, 0
        for r in self.trials():
            x = spark.read.parquet(f"{self.path}/returns/{r['config_hash']}").select(F.lit(r["config_hash"]).alias("trial"), "date", "ret").where("ret IS NOT NULL")
            out, k = x if out is None else out.unionByName(x), k + 1
        if out is None:
            raise ValueError("the ledger is empty")
        both = out.groupBy("date").agg(F.countDistinct("trial").alias("k")).where(F.col("k") == k).select("date")
        from ..operators.joins import calendar

        days = calendar(both)
        if days.count() < least:
            raise ValueError("the trials share too few dates")
        return out.join(days, "date").select("trial", "t", "ret")
