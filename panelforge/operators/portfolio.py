"""Portfolios from signals, their returns, costs and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .panel import KEYS

YEAR = 365


def with_weights(panel: DataFrame, signal: str, fraction: float = 0.1, name: str = "weight", by: tuple[str, ...] = ()) -> DataFrame:
    """`panel` with equal weights of each date's top (+1 in all) and bottom (-1 in all) fraction; else 0.

    Limits are interpolated quantiles of the known signals; where both hold, the short side counts.
    Here and below, `by` are columns that hold several portfolios apart: formulas, or windows.
    """
    s, date = F.col(signal), C.date(by)
    limits = F.percentile(s, F.array(F.lit(1 - fraction), F.lit(fraction))).over(date)  # one pass for both
    high, low = F.get(limits, F.lit(0)), F.get(limits, F.lit(1))
    marked = panel.withColumns({"_long": F.coalesce(s >= high, F.lit(False)), "_short": F.coalesce(s <= low, F.lit(False))})
    count = lambda c: F.sum(F.col(c).cast("int")).over(date)
    weight = F.when(F.col("_short"), -1.0 / count("_short")).when(F.col("_long"), 1.0 / count("_long")).otherwise(0.0)
    return marked.withColumn(name, weight).drop("_long", "_short")


def decile_returns(panel: DataFrame, signal: str, ret: str, n: int = 10) -> DataFrame:
    """date_utc, decile (from 1), ret: the mean return of each quantile bucket of each date.

    Edges are the date's interpolated quantiles without repeats; a date with fewer than `n` signals,
    or a single edge, has no buckets.
    """
    s = F.col(signal) + 0.0
    steps = F.array(*[F.lit(k / n) for k in range(n + 1)])
    known = panel.where(F.col(signal).isNotNull()).select("date_utc", s.alias("s"), F.col(ret).alias("r"))
    edged = known.withColumns({"_n": F.count("*").over(C.date()), "_e": F.array_distinct(F.percentile("s", steps).over(C.date()))})
    bucket = F.greatest(F.size(F.filter("_e", lambda e: e < F.col("s"))) - 1, F.lit(0)) + 1
    return edged.where((F.col("_n") >= n) & (F.size("_e") > 1)).groupBy("date_utc", bucket.alias("decile")).agg(F.avg("r").alias("ret"))


def daily_returns(panel: DataFrame, weight: str, ret: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, date_utc, ret: the weighted return of each date; 0 where nothing is known."""
    return panel.groupBy(*by, "date_utc").agg(F.coalesce(F.sum(F.col(weight) * F.col(ret)), F.lit(0.0)).alias("ret"))


def daily_turnover(panel: DataFrame, weight: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, date_utc, turnover: changes of weight since the panel date before; the first date has 0.

    A ticker that either date lacks adds nothing. The dates' order comes from their small distinct
    table, joined to the rows, so that no window spans the panel.
    """
    dates = panel.select(*by, "date_utc").distinct()
    before = dates.select(*by, "date_utc", F.lag("date_utc").over(Window.partitionBy(*by).orderBy("date_utc")).alias("_before"))
    rows = C.ticker(by)
    moved = panel.select(*by, *KEYS, F.col(weight).alias("w")).withColumns({"_w": F.lag("w").over(rows), "_d": F.lag("date_utc").over(rows)})
    change = F.when(F.col("_d") == F.col("_before"), F.abs(F.col("w") - F.col("_w")))
    return moved.join(before, [*by, "date_utc"]).groupBy(*by, "date_utc").agg(F.coalesce(F.sum(change), F.lit(0.0)).alias("turnover"))


def net_returns(panel: DataFrame, weight: str, ret: str, bps: float, by: tuple[str, ...] = ()) -> DataFrame:
    """by, date_utc, ret, turnover, net: returns less `bps` of turnover."""
    both = daily_returns(panel, weight, ret, by).join(daily_turnover(panel, weight, by), [*by, "date_utc"])
    return both.withColumn("net", F.col("ret") - F.col("turnover") * bps / 1e4)


def sharpe(ret: Column) -> Column:
    """Aggregate: annualised mean by population deviation; 0 for fewer than two dates or none that differ."""
    return F.when((F.count(ret) >= 2) & (F.stddev_pop(ret) > 0), F.avg(ret) / F.stddev_pop(ret) * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0)


def curves(daily: DataFrame, ret: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    """by, date_utc, ret, cum_sum, cum_prod, peak, drawdown of daily series, each of which is as long as there are dates."""
    w = Window.partitionBy(*by).orderBy("date_utc").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.select(*by, "date_utc", F.col(ret).alias("ret")).withColumns({"cum_sum": F.sum("ret").over(w), "cum_prod": F.product(1 + F.col("ret")).over(w)})
    return out.withColumn("peak", F.max("cum_prod").over(w)).withColumn("drawdown", F.try_divide(F.col("cum_prod") - F.col("peak"), F.col("peak")))


def max_drawdown(daily: DataFrame, ret: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    return curves(daily, ret, by).groupBy(*by).agg(F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"))


def mean_turnover_of_cells(panel: DataFrame, weight: str) -> DataFrame:
    """turnover: the mean absolute change of a ticker's weight from row to row."""
    return panel.select(F.abs(F.col(weight) - F.lag(weight).over(C.ticker())).alias("d")).agg(F.avg("d").alias("turnover"))


def exposure(panel: DataFrame, weight: str, category: str = "category") -> DataFrame:
    return panel.groupBy(category).agg(F.sum(weight).alias("exposure"))


def exposure_to(panel: DataFrame, weight: str, dummies: list[str]) -> DataFrame:
    """dummy, exposure: the sum of weight times each dummy, which may overlap; one aggregation for all."""
    sums = panel.agg(*[F.coalesce(F.sum(F.col(weight) * F.col(d).cast("double")), F.lit(0.0)).alias(d) for d in dummies])
    return sums.unpivot([], dummies, "dummy", "exposure")
