"""Stored market data: partitioned tables, gaps in them, sinks and their metadata."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cleaning import day_spans

def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class MarketStore:
    """A table of observations partitioned by source, symbol and day, below `root` (any path Spark reads).

    A store starts empty: what isn't there yet reads as no rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _stored(self, source: str) -> DataFrame | None:
        path = f"{self.root}/observations"
        return self.spark.read.option("basePath", path).parquet(f"{path}/source={source}") if path_exists(self.spark, f"{path}/source={source}") else None

    def store(self, rows: DataFrame, source: str, *, at: str, symbol: str = "symbol") -> None:
        """Adds rows, one for each symbol and instant; days that are there already are replaced, others stay."""
        out = rows.withColumns({"source": F.lit(source), "symbol": F.col(symbol), "day": F.to_date(at)}).dropDuplicates(["symbol", at])
        (
            out.repartition("source", "symbol", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("source", "symbol", "day").parquet(f"{self.root}/observations")
        )

    def load_range(self, source: str, start: str, end: str, symbol: str | None = None) -> DataFrame:
        """Rows of the days from `start` to `end`; only those partitions are read. An unknown source has no rows, and no columns but the keys."""
        rows = self._stored(source)
        if rows is None:
            return self.spark.createDataFrame([], "source string, symbol string, day date")
        rows = rows.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        return rows if symbol is None else rows.where(F.col("symbol") == symbol)

    def missing(self, source: str, start: str, end: str, symbols: list[str] | DataFrame | None = None, *, ttl_hours: int = 24) -> DataFrame:
        """symbol, day that are neither stored nor marked as empty within the last `ttl_hours`.

        `symbols` are the wanted ones, a list or a table of symbol; without them, those that are stored.
        """
        stored = self._stored(source)
        present = self.spark.createDataFrame([], "symbol string, day date") if stored is None else stored.select(F.col("symbol").cast("string").alias("symbol"), "day").distinct()
        if symbols is None:
            symbols = present.select("symbol")
        elif not isinstance(symbols, DataFrame):
            symbols = self.spark.createDataFrame([(x,) for x in symbols], "symbol string")
        days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
        gaps = symbols.select("symbol").distinct().select("symbol", days).join(present, ["symbol", "day"], "left_anti")
        if not path_exists(self.spark, f"{self.root}/empty_days"):
            return gaps
        marks = self.spark.read.parquet(f"{self.root}/empty_days")
        fresh = marks.where((F.col("source") == source) & (F.col("marked_at") > F.current_timestamp() - F.make_interval(hours=F.lit(ttl_hours))))
        return gaps.join(fresh.select("symbol", "day"), ["symbol", "day"], "left_anti")

    def mark_empty(self, days: DataFrame, source: str) -> None:
        """Records (symbol, day) for which a source confirmed that there is nothing."""
        days.select("symbol", "day", F.lit(source).alias("source"), F.current_timestamp().alias("marked_at")).write.mode("append").parquet(f"{self.root}/empty_days")

    def missing_spans(self, source: str, start: str, end: str, symbols: list[str] | DataFrame | None = None, *, ttl_hours: int = 24) -> DataFrame:
        """symbol, first_day, last_day, n_days: the maximal spans of missing() days, each of which one request can ask for."""
        return day_spans(self.missing(source, start, end, symbols, ttl_hours=ttl_hours), ["symbol"])

    def fill(self, source: str, start: str, end: str, read, *, at: str, symbol: str = "symbol", symbols: list[str] | DataFrame | None = None, spans: bool = False) -> int:
        """Reads what is missing by `read(days)` (days: symbol, day), stores it, and marks days that had nothing.

        With `spans`, `read` gets missing_spans() instead, so that it asks once for days in a row.
        Returns the number of days that were missing. If `read` fails, nothing is marked, so that
        only confirmed gaps are.
        """
        gaps = self.missing(source, start, end, symbols).persist()
        try:
            n = gaps.count()
            if n:
                rows = read(day_spans(gaps, ["symbol"]) if spans else gaps).persist()
                found = rows.select(F.col(symbol).alias("symbol"), F.to_date(at).alias("day")).distinct()
                self.mark_empty(gaps.join(found, ["symbol", "day"], "left_anti"), source)
                if not rows.isEmpty():
                    self.store(rows, source, at=at, symbol=symbol)
                rows.unpersist()
            return n
        finally:
            gaps.unpersist()

    def availability(self, source: str) -> DataFrame:
        rows = self._stored(source)
        if rows is None:
            return self.spark.createDataFrame([], "symbol string, first_day date, last_day date, n_rows long")
        return rows.groupBy("symbol").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_rows"))

    def symbol_available(self, source: str, symbol: str) -> bool:
        return path_exists(self.spark, f"{self.root}/observations/source={source}/symbol={symbol}")

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def clear_source(self, source: str) -> None:
        """Forgets all rows of a source; its marks of empty days run out by themselves."""
        self._delete(f"{self.root}/observations/source={source}")

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/tables/{name}")

    def exists(self, name: str) -> bool:
        return path_exists(self.spark, f"{self.root}/tables/{name}")

    def read(self, name: str) -> DataFrame | None:
        """The table of that name; None if there is none."""
        return self.spark.read.parquet(f"{self.root}/tables/{name}") if self.exists(name) else None


class VersionedStore(MarketStore):
    """A store that several may write at once, in which what is read is always whole.

    Rows go to a folder of their own, `commits/commit=ID`, which nobody reads until an empty file
    `versions/NUMBER-ID` is there, made in one step once all tasks are done. Of a symbol's day the rows of the
    latest version count, of equal numbers (writers at the same time) those of the larger id, so
    every reader sees the same. A write that fails leaves a folder that vacuum() takes away.
    """

    def _files(self, folder: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[str]:
        """Ids of commits, from the first on."""
        return [f.split("-", 1)[1] for f in self._files("versions")]

    def _publish(self, commit: str) -> None:
        last = max((int(f.split("-", 1)[0]) for f in self._files("versions")), default=0)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions/{last + 1:012d}-{commit}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(at)

    def prepare(self, rows: DataFrame, source: str, *, at: str, symbol: str = "symbol") -> str:
        """Writes rows, one for each symbol and instant, without publishing them; the commit's id."""
        commit = uuid.uuid4().hex
        out = rows.withColumns({"source": F.lit(source), "symbol": F.col(symbol), "day": F.to_date(at)}).dropDuplicates(["symbol", at])
        out.repartition("source", "symbol", "day").write.partitionBy("source", "symbol", "day").parquet(f"{self.root}/commits/commit={commit}")
        return commit

    def store(self, rows: DataFrame, source: str, *, at: str, symbol: str = "symbol") -> None:
        """Adds rows, one for each symbol and instant, all at once; days that are there already are replaced, others stay."""
        self._publish(self.prepare(rows, source, at=at, symbol=symbol))

    def _stored(self, source: str) -> DataFrame | None:
        order = self.versions()
        have = [c for c in order if path_exists(self.spark, f"{self.root}/commits/commit={c}/source={source}")]
        if not have:
            return None
        path = f"{self.root}/commits"
        rows = self.spark.read.option("basePath", path).option("mergeSchema", True).parquet(*[f"{path}/commit={c}/source={source}" for c in have])
        number = self.spark.createDataFrame([(c, k) for k, c in enumerate(order)], "commit string, _number int")
        # one row for each folder of a symbol's day
        latest = rows.select("symbol", "day", "commit").distinct().join(F.broadcast(number), "commit").groupBy("symbol", "day").agg(F.max_by("commit", "_number").alias("commit"))
        return rows.join(latest, ["symbol", "day", "commit"], "left_semi").drop("commit")

    def symbol_available(self, source: str, symbol: str) -> bool:
        return any(path_exists(self.spark, f"{self.root}/commits/commit={c}/source={source}/symbol={symbol}") for c in self.versions())

    def clear_source(self, source: str) -> None:
        """Forgets all rows of a source; its marks of empty days run out by themselves."""
        for c in self.versions():
            self._delete(f"{self.root}/commits/commit={c}/source={source}")

    def vacuum(self) -> int:
        """Deletes the folders of writes that weren't published, and says how many; for when nobody writes."""
        lost = [f for f in self._files("commits") if f.removeprefix("commit=") not in set(self.versions())]
        for f in lost:
            self._delete(f"{self.root}/commits/{f}")
        return len(lost)


def ohlcv_rows(raw: DataFrame) -> DataFrame:
    """timestamp_ms, open, high, low, close, volume, date_utc, symbol from candle records."""
    return raw.select("timestamp_ms", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")], F.timestamp_millis("timestamp_ms").alias("date_utc"), "symbol")


def universe_rows(raw: DataFrame, snapshot: str, top: int) -> DataFrame:
    """The `top` coins by market value: id, symbol in upper case, name, market_cap, market_cap_rank, current_price, categories, snapshot_date."""
    day = F.lit(snapshot).cast("date")
    rows = raw.orderBy(F.col("market_cap").desc_nulls_last(), "id").limit(top)
    return rows.select(
        "id", F.upper("symbol").alias("symbol"), "name", F.col("market_cap").cast("double").alias("market_cap"), F.col("market_cap_rank").cast("int").alias("market_cap_rank"),
        F.col("current_price").cast("double").alias("current_price"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), day.alias("date_utc"), day.alias("snapshot_date"),
    )


def fresh_universe(snapshots: DataFrame, today: str, ttl_hours: int = 24) -> DataFrame:
    """The latest snapshot, if it is not older than `ttl_hours`; else no rows."""
    latest = snapshots.agg(F.max("snapshot_date").alias("_d")).where(F.datediff(F.lit(today).cast("date"), "_d") * 24 <= ttl_hours)
    return snapshots.join(F.broadcast(latest), F.col("snapshot_date") == F.col("_d")).drop("_d")


def funding_rows(raw: DataFrame) -> DataFrame:
    """funding_time, funding_rate, mark_price, symbol from records of text fields; an empty price is 0."""
    price = F.coalesce(F.try_to_number("markPrice", F.lit("999999999999.999999999999")).cast("double"), F.lit(0.0))
    return raw.select(F.timestamp_millis("fundingTime").alias("funding_time"), F.col("fundingRate").cast("double").alias("funding_rate"), price.alias("mark_price"), "symbol")


def taker_rows(raw: DataFrame) -> DataFrame:
    """date_utc, volume, taker_buy_base, taker_buy_ratio, taker_net_volume, symbol from kline records."""
    v, b = F.col("volume").cast("double"), F.col("taker_buy_base").cast("double")
    share = lambda x: F.when(v > 0, x / v)
    return raw.select(F.timestamp_millis("open_ms").alias("date_utc"), v.alias("volume"), b.alias("taker_buy_base"), share(b).alias("taker_buy_ratio"), share(2 * b - v).alias("taker_net_volume"), "symbol")


def interest_rows(raw: DataFrame) -> DataFrame:
    x = F.col("openInterest").cast("double")
    return raw.select(F.timestamp_millis(F.col("timestamp").cast("long")).alias("timestamp"), x.alias("open_interest"), x.alias("open_interest_usd"), "symbol")


def long_short_rows(raw: DataFrame) -> DataFrame:
    buy, sell = F.col("buyRatio").cast("double"), F.col("sellRatio").cast("double")
    return raw.select(F.timestamp_millis(F.col("timestamp").cast("long")).alias("timestamp"), buy.alias("buy_ratio"), sell.alias("sell_ratio"), F.try_divide(buy, F.nullif(sell, F.lit(0.0))).alias("ls_ratio"), "symbol")


def synthetic_panel(spark: SparkSession, *, tickers: int = 50, days: int = 365, seed: int = 42, start: str = "2023-01-01") -> DataFrame:
    """A seeded random panel: date_utc, ticker, 16 noise factors and market columns."""
    def noise(k: int) -> Column:
        return F.randn(seed + k)

    base = spark.range(tickers * days, numPartitions=4).select(
        "id", F.date_add(F.lit(start).cast("date"), (F.col("id") / tickers).cast("int")).alias("date_utc"),
        F.concat(F.lit("TICKER_"), F.lpad((F.col("id") % tickers).cast("string"), 3, "0")).alias("ticker"), (noise(20) * 0.02).alias("_step"),
    )
    # the walk goes over all tickers of a date, then of the next: steps within a date, and the sums of the dates before
    within = Window.partitionBy("date_utc").orderBy("ticker").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("date_utc").rowsBetween(Window.unboundedPreceding, -1)
    sums = base.groupBy("date_utc").agg(F.sum("_step").alias("_sum")).select("date_utc", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    walked = base.withColumn("_walk", F.sum("_step").over(within)).join(sums, "date_utc")
    buy, sell = 1e6 + 9.9e7 * F.rand(seed + 30), 1e6 + 9.9e7 * F.rand(seed + 31)
    return walked.select(
        "date_utc", "ticker", *[noise(k).alias(f"factor_{k:02d}") for k in range(16)],
        (100 * F.exp(F.col("_walk") + F.col("_before"))).alias("close"), (1e6 + 9.9e7 * F.rand(seed + 21)).alias("volume"), (1e8 + 9.9e9 * F.rand(seed + 22)).alias("market_cap"),
        (noise(23) * 0.001).alias("funding_rate"), (buy / (buy + sell)).alias("taker_buy_ratio"), ((buy - sell) / (buy + sell)).alias("taker_net_volume"),
        (1e7 + 9.9e8 * F.rand(seed + 24)).alias("oi_usd"), (0.3 + 0.4 * F.rand(seed + 25)).alias("ls_ratio"),
        F.get(F.array(*[F.lit(c) for c in ("DeFi", "L1", "L2", "Meme", "Gaming")]), (F.rand(seed + 26) * 5).cast("int")).alias("category"),
    )


def revision(folder: str | None = None) -> str:
    """The commit of the checkout that holds this code, or `folder`; "unknown" where there is none."""
    try:
        found = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder or os.path.dirname(os.path.abspath(__file__)), capture_output=True, text=True, timeout=10, check=True)
    except (OSError, subprocess.SubprocessError):
        return "unknown"
    return found.stdout.strip() or "unknown"


def metadata(config: dict, *, seed: int, generations: int, population: int, revision: str = "unknown", cost_bps: float = 0.0) -> dict:
    """What belongs beside a result: seed, sizes, units, time, and a digest of the sorted configuration."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]
    returns = "daily, net of transaction costs" if cost_bps > 0 else "daily, gross"
    return {
        "seed": seed, "n_gen": generations, "pop_size": population, "annualization_factor": 365, "timestamp": datetime.now(UTC).isoformat(),
        "config_hash": digest, "git_sha": revision, "units": {"sharpe": "annualized (sqrt(365))", "ic": "daily rank IC (Spearman)", "returns": returns},
    }


def write_report(rows: DataFrame, path: str, meta: dict | None = None) -> None:
    """A CSV with a header, and its metadata as JSON in the folder it is in; nothing but the empty CSV for no rows."""
    rows.write.mode("overwrite").option("header", True).csv(path)
    if meta is not None and not rows.isEmpty():
        spark = rows.sparkSession
        spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rsplit('/', 1)[0]}/meta.json")


def write_front(spark: SparkSession, front: list[tuple[str, float, float, float]], folder: str, meta: dict | None = None) -> None:
    """pareto_front.csv: formula and its three objectives, a row for each formula of the front."""
    rows = spark.createDataFrame(front, "formula string, f1_rank_ic double, f2_stability double, f3_diversity double")
    write_report(rows.coalesce(1), f"{folder}/pareto_front.csv", meta)


def write_diagnostics(report: DataFrame, folder: str, meta: dict | None = None) -> None:
    """diagnostics.csv and full_report.csv: a row of measures for each formula, to four digits."""
    kinds = dict(report.dtypes)
    rows = report.select(*[F.round(c, 4).alias(c) if kinds[c] == "double" else F.col(c) for c in report.columns]).coalesce(1)
    write_report(rows, f"{folder}/diagnostics.csv", meta)
    write_report(rows, f"{folder}/full_report.csv")
