"""Column builders over a panel with the keys date_utc and ticker.

Time-series functions go by rows of a ticker in date order, cross-sectional ones by date. Missing
is NULL everywhere. All are built-in expressions, so Catalyst groups those of one partitioning into
one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ticker(by=()):
    """A ticker's rows in date order, apart for each value of `by`."""
    return Window.partitionBy(*by, "ticker").orderBy("date_utc")


def date(by=()):
    """The rows of a date, apart for each value of `by`."""
    return Window.partitionBy(*by, "date_utc")


def trailing(rows: int):
    """The current row and the rows - 1 before it."""
    return ticker().rowsBetween(-(rows - 1), 0)


def lag(x: Column, rows: int) -> Column:
    return F.lag(x, rows).over(ticker())


def safe_div(x: Column, y: Column) -> Column:
    """x / y; NULL where y is within 1e-10 of 0."""
    return F.when(F.abs(y) > 1e-10, x / y)


def ts_mean(x: Column, rows: int, least: int | None = None) -> Column:
    """Mean over the window; NULL with fewer than `least` (all) values."""
    w = trailing(rows)
    return F.when(F.count(x).over(w) >= (least or rows), F.avg(x).over(w))


def ts_std(x: Column, rows: int, least: int | None = None) -> Column:
    """Population deviation over the window; NULL with fewer than `least` (all) values."""
    w = trailing(rows)
    return F.when(F.count(x).over(w) >= (least or rows), F.stddev_pop(x).over(w))


def ts_skew(x: Column, rows: int, least: int) -> Column:
    """Bias-adjusted skewness over the window."""
    w = trailing(rows)
    n = F.count(x).over(w).cast("double")
    return F.when(n >= least, F.skewness(x).over(w) * F.sqrt(n * (n - 1)) / (n - 2))


def delta(x: Column, rows: int) -> Column:
    return x - lag(x, rows)


def ts_rank(x: Column, rows: int) -> Column:
    """Average-tie percentile rank of the current value within its own window; NULL unless the window is full."""
    values = F.collect_list(x).over(trailing(rows))
    below = F.size(F.filter(values, lambda v: v < x))
    same = F.size(F.filter(values, lambda v: v == x))
    return F.when(x.isNotNull() & (F.size(values) == rows), (below + (same + 1) / 2) / rows)


def cs_rank(x: Column, by=None) -> Column:
    """Average-tie rank by the number of values, in (0, 1].

    Tied values take the average of the first and the last of their ranks, and the last is how many
    values there are up to them: both grow along one sort.
    """
    by = by or date()
    up_to = by.orderBy(x.asc_nulls_last())
    last = F.count(x).over(up_to.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(up_to) + last) / 2 / F.count(x).over(by))


def cs_zscore(x: Column) -> Column:
    return (x - F.avg(x).over(date())) / F.nullif(F.stddev_pop(x).over(date()), F.lit(0.0))


def cs_winsor(x: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Clipped to the date's linearly interpolated quantiles."""
    limits = F.percentile(x, F.array(F.lit(low), F.lit(high))).over(date())  # one pass for both
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.get(limits, F.lit(0))), F.get(limits, F.lit(1))))


def cs_neutralize(x: Column, category: str = "category") -> Column:
    """Residual of a date's regression on one-hot categories: what is left after the category's mean."""
    return F.when(F.count(x).over(date()) >= 2, x - F.avg(x).over(Window.partitionBy("date_utc", category)))


def padded(x: Column) -> Column:
    """The last value so far of the ticker."""
    return F.last(x, ignorenulls=True).over(ticker())


def ffill_limited(x: Column, most: int) -> Column:
    """Forward fill of at most `most` rows after the last value."""
    since = F.collect_list(F.when(x.isNotNull(), x)).over(ticker().rowsBetween(-most, 0))
    return F.coalesce(x, F.try_element_at(since, F.lit(-1)))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the jointly known pairs of a group; NULL where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
