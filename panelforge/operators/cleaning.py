"""Panel assembly and cleaning: symbols, resampling, merging, lags and gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .panel import KEYS

#: What counts as a stablecoin.
STABLECOINS = ["USDT", "USDC", "DAI", "BUSD", "TUSD", "FDUSD"]


def exchange_symbol(symbol: Column, *, perpetual: bool) -> Column:
    """A base symbol as an exchange names it; NULL for a stablecoin."""
    base = F.upper(symbol)
    return F.when(~base.isin(STABLECOINS), F.concat(base, F.lit("/USDT:USDT" if perpetual else "USDT")))


def normalised_symbol(symbol: Column) -> Column:
    return F.upper(F.replace(F.replace(symbol, F.lit("_"), F.lit("/")), F.lit(":USDT"), F.lit("")))


def harmonised_symbol(symbol: Column) -> Column:
    """BASE/QUOTE in upper case, whatever separates them; a bare USDT suffix is split off."""
    s = F.translate(F.upper(symbol), "_-", "//")
    parts = F.split(s, "/")
    s = F.when(F.size(parts) > 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(s)
    return F.when(s.endswith("USDT") & ~s.contains("/"), F.concat(F.substring(s, F.lit(1), F.length(s) - 4), F.lit("/USDT"))).otherwise(s)


def daily_last(observations: DataFrame, *, symbol: str, at: str, value: str, tie: str) -> DataFrame:
    """The last known value of each symbol and day, the largest `tie` of those at one instant."""
    return (
        observations.where(F.col(value).isNotNull())
        .groupBy(F.col(symbol).alias("ticker"), F.to_date(at).alias("date_utc"))
        .agg(F.max_by(F.col(value), F.struct(at, tie)).alias(value))
    )


def top_universe(universe: DataFrame, n: int, *, by: str = "market_cap", tie: str = "symbol") -> DataFrame:
    return universe.orderBy(F.col(by).desc_nulls_last(), tie).limit(n)


def last_wins(frames: list[DataFrame], *, order: str) -> DataFrame:
    """Union of frames, for each key the latest known value by `order` of each column.

    A column is NULL where no row of the key knows it; a row of which nothing is known goes.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in rows.columns if c not in (*KEYS, order)]
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values]
    return rows.groupBy(*KEYS).agg(*latest).dropna("all", subset=values)


def first_wins(rows: DataFrame, keys: list[str], *, order: str) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*values), F.col(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in values])


def outer_merge(frames: dict[str, DataFrame]) -> DataFrame:
    """Narrow frames (keys and one value) side by side, each key that any has.

    A full outer join of many frames as one union and one aggregation: one exchange, not one for
    each. Keys are unique in each frame.
    """
    names = list(frames)
    rows = [
        df.select(*KEYS, *[(F.col(name) if other == name else F.lit(None).cast(df.schema[name].dataType)).alias(other) for other in names])
        for name, df in frames.items()
    ]
    merged = reduce(DataFrame.unionByName, rows)
    return merged.groupBy(*KEYS).agg(*[F.max(n).alias(n) for n in names])


def with_universe(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Static columns of each ticker: market_cap, and the first of its categories, or Other."""
    static = universe.select(
        F.col("symbol").alias("ticker"), F.col("market_cap"),
        F.coalesce(F.try_element_at("categories", F.lit(1)), F.lit("Other")).alias("category"),
    )
    own = [c for c in panel.columns if c not in ("market_cap", "category")]
    return panel.select(*own).join(static, "ticker", "left").select(*own, "market_cap", F.coalesce("category", F.lit("Other")).alias("category"))


def utc_day(at: Column, zone: Column | str = "UTC") -> Column:
    return F.to_date(F.date_trunc("day", F.to_utc_timestamp(at, zone)))


def lagged(panel: DataFrame, column: str = "funding_rate", rows: int = 1) -> DataFrame:
    return panel.withColumn(column, C.lag(F.col(column), rows))


def filled(panel: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Forward fill within each ticker, of at most `most` rows after a value."""
    return panel.withColumns({c: C.ffill_limited(F.col(c), most) for c in columns})


def clean_panel(panel: DataFrame, *, funding_lag: int = 1, max_gap: int = 3, zone: str = "UTC") -> DataFrame:
    """Harmonised tickers where there is a symbol column, days in UTC, funding lagged, all columns gap-filled.

    A timestamp in date_utc is taken as local time of `zone`; dates stay as they are.
    """
    if "symbol" in panel.columns and "ticker" not in panel.columns:
        panel = panel.withColumn("ticker", harmonised_symbol(F.col("symbol"))).drop("symbol")
    if dict(panel.dtypes)["date_utc"] != "date":
        panel = panel.withColumn("date_utc", utc_day(F.col("date_utc"), zone))
    if "funding_rate" in panel.columns:
        panel = lagged(panel, "funding_rate", funding_lag)
    return filled(panel, [c for c in panel.columns if c not in KEYS], max_gap)


def split_at(panel: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """In-sample before the day, out-of-sample from it on."""
    return panel.where(F.col("date_utc") < F.lit(day).cast("date")), panel.where(F.col("date_utc") >= F.lit(day).cast("date"))


def missing_days(present: DataFrame, *, start: str, end: str, keys: list[str]) -> DataFrame:
    """Days from `start` to `end` that a key of `present` (keys, date_utc) lacks."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date_utc")
    wanted = present.select(*keys).distinct().select(*keys, days)
    return wanted.join(present.select(*keys, "date_utc").distinct(), [*keys, "date_utc"], "left_anti")


def first_available(present: DataFrame, keys: list[str]) -> DataFrame:
    return present.groupBy(*keys).agg(F.min("date_utc").alias("first_date"), F.max("date_utc").alias("last_date"), F.count_distinct("date_utc").alias("n_dates"))


def day_spans(days: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """keys, first_day, last_day, n_days: maximal runs of days that follow each other, of the days of each key.

    Days less their number in order are the same throughout a run. Repeated days count once; a null one makes none.
    """
    d = F.col(day).cast("date")
    rows = days.select(*keys, d.alias("_day")).where(F.col("_day").isNotNull()).distinct()
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_day"))
    runs = rows.withColumn("_run", F.date_sub("_day", number)).groupBy(*keys, "_run")
    return runs.agg(F.min("_day").alias("first_day"), F.max("_day").alias("last_day"), F.count("*").alias("n_days")).drop("_run")


def span_days(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, day: the days of spans (keys, first_day, last_day)."""
    return spans.select(*keys, F.explode(F.sequence("first_day", "last_day")).alias("day"))
