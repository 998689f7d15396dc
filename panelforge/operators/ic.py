"""Rank information coefficients, their stability, decay and diversity, and look-ahead guards."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .panel import KEYS, LookaheadBiasError

LEAST = 10
INFEASIBLE = (-99.0, -99.0, 0.0)


def daily_ic(signals: DataFrame, ret: str, *, joint: bool = False, ranked: bool = False, by: list[str] = ("formula",), least: int = LEAST) -> DataFrame:
    """by, date_utc, ic of long rows (by, date_utc, x, `ret`): the rank correlation of each date.

    With `ranked`, `ret` already is the return's rank over its date.

    Each side is ranked over its own known values and pairs are matched after that, on dates with
    `least` known signals; with `joint`, pairs are matched first, and `least` counts pairs. Dates
    whose correlation isn't defined are left out. All formulas go through one exchange.
    """
    keys = [*by, "date_utc"]
    rows = signals.select(*keys, "x", F.col(ret).alias("r"))
    if joint:
        rows = rows.where(F.col("x").isNotNull() & F.col("r").isNotNull())
    w = Window.partitionBy(*keys)
    sides = rows.select(*keys, "x", C.cs_rank(F.col("x"), w).alias("_a"), (F.col("r") if ranked else C.cs_rank(F.col("r"), w)).alias("_b"))
    daily = sides.groupBy(*keys).agg(F.count("x").alias("n"), C.safe_corr(F.col("_a"), F.col("_b")).alias("ic"))
    return daily.where((F.col("n") >= least) & F.col("ic").isNotNull()).drop("n")


def wide_ic(wide: DataFrame, names: list[str], ret: str, least: int = LEAST) -> DataFrame:
    """formula, date_utc, ic of the named columns: daily_ic() of all of them, for which the return is ranked once."""
    from ..plans.batch import long_form

    rows = wide.withColumn("_rank", C.cs_rank(F.col(ret)))
    return daily_ic(long_form(rows, names, ["date_utc", "_rank"]), "_rank", ranked=True, least=least)


def newey_west(daily: DataFrame, by: list[str] = ("formula",)) -> DataFrame:
    """by, n, mean_ic, se, stability of daily series: autocorrelation-robust standard errors.

    Bartlett weights up to the lag floor(4 (n / 100)^(2/9)), at least 1 and below n. A series is as
    long as there are dates, so it is one array in its group.
    """
    series = daily.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ic").alias("mean_ic"), F.array_sort(F.collect_list(F.struct("date_utc", "ic"))).alias("s"))
    n = F.col("n")
    most = F.greatest(F.lit(1), F.least(F.floor(4 * F.pow(n / 100, F.lit(2 / 9))).cast("int"), (n - 1).cast("int")))
    e = F.transform("s", lambda p: p["ic"] - F.col("mean_ic"))

    def gamma(lag: Column) -> Column:
        products = F.transform(F.col("e"), lambda v, i: F.when(i >= lag, v * F.get(F.col("e"), (i - lag).cast("int"))).otherwise(0.0))
        return F.aggregate(products, F.lit(0.0), lambda a, v: a + v) / F.col("n")

    weighted = F.aggregate(
        F.sequence(F.lit(1), F.col("lags")), gamma(F.lit(0)), lambda total, k: total + 2 * (1 - k / (F.col("lags") + 1)) * gamma(k)
    )
    out = series.withColumns({"e": e, "lags": most}).withColumn("v", F.when(n >= 2, weighted * n / (n - 1)))
    se = F.when((n >= 2) & (F.col("v") > 0), F.sqrt(F.col("v") / n)).otherwise(0.0)
    return out.withColumn("se", se).select(*by, "n", "mean_ic", "se", F.when(F.col("se") > 0, F.abs("mean_ic") / F.col("se")).otherwise(0.0).alias("stability"))


def horizon_ic(signals: DataFrame, ret: str, horizons: list[int]) -> DataFrame:
    """formula, horizon, date_utc, ic: rank correlations with the return `horizon` rows further on.

    `signals` has ticker too. All horizons are one pass: leads share the sort by ticker.
    """
    w = Window.partitionBy("formula", "ticker").orderBy("date_utc")
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead(ret, h).over(w).alias("r")) for h in horizons])
    rows = signals.select("formula", "date_utc", "x", pairs.alias("p")).select("formula", "date_utc", "x", F.explode("p").alias("p"))
    return daily_ic(rows.select("formula", "date_utc", "x", "p.horizon", "p.r"), "r", by=["formula", "horizon"])


def _all_horizons(signals: DataFrame, horizons: list[int]) -> DataFrame:
    return signals.select("formula").distinct().select("formula", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))


def ic_decay(signals: DataFrame, ret: str, horizons: list[int]) -> DataFrame:
    """formula, horizon, ic: the mean of horizon_ic(); 0 where no date has one."""
    means = horizon_ic(signals, ret, horizons).groupBy("formula", "horizon").agg(F.avg("ic").alias("ic"))
    return _all_horizons(signals, horizons).join(means, ["formula", "horizon"], "left").select("formula", "horizon", F.coalesce("ic", F.lit(0.0)).alias("ic"))


def ic_decay_ci(signals: DataFrame, ret: str, horizons: list[int], *, replicates: int = 200, block: float = 10.0, seed: int = 42) -> DataFrame:
    """formula, horizon, mean, lower, upper: ic_decay() with a 95 % interval of the stationary bootstrap.

    A series of fewer than ten dates, or a constant one, has its mean three times; an empty one 0.
    """
    from .validation import bootstrap_ci

    daily = horizon_ic(signals, ret, horizons)
    found = bootstrap_ci(daily, ["formula", "horizon"], replicates=replicates, block=block, seed=seed)
    means = daily.groupBy("formula", "horizon").agg(F.avg("ic").alias("_mean"))
    out = _all_horizons(signals, horizons).join(found, ["formula", "horizon"], "left").join(means, ["formula", "horizon"], "left")
    return out.select("formula", "horizon", *[F.coalesce(c, "_mean", F.lit(0.0)).alias(c) for c in ("mean", "lower", "upper")])


#: Rows of a date whose products one task sums.
BLOCK = 4_096


def _meetings(rows: DataFrame, first_other: int, least: int) -> DataFrame:
    """date_utc, left, right, at: for each date and each two patterns of known rows, one of a name's and one of an other's,
    a column of either pattern, and the numbers of all columns that have one of them.

    Columns of one pattern are known on the same rows, as two hashes over these tell.
    """
    known = rows.select("date_utc", F.xxhash64("_id").alias("_h"), F.xxhash64("_id", F.lit(1)).alias("_g"), F.posexplode("_v").alias("_at", "_x")).where("_x is not null")
    columns = known.groupBy("date_utc", "_at").agg(F.count("*").alias("_n"), F.bit_xor("_h").alias("_h"), F.bit_xor("_g").alias("_g")).where(F.col("_n") >= least)
    date = columns.groupBy("date_utc").agg(F.array_sort(F.collect_list(F.struct("_at", F.struct("_n", "_h", "_g").alias("_pattern")))).alias("_all"))
    side = lambda left: F.filter("_all", lambda c: (c["_at"] < first_other) if left else (c["_at"] >= first_other))
    # as arrays of the columns of each pattern of a side
    grouped = lambda own: F.transform(
        F.array_distinct(F.transform(own, lambda c: c["_pattern"])), lambda p: F.transform(F.filter(own, lambda c: c["_pattern"] == p), lambda c: c["_at"])
    )
    date = date.select("date_utc", F.explode(grouped(side(True))).alias("_left"), grouped(side(False)).alias("_rights"))
    pairs = date.select("date_utc", "_left", F.explode("_rights").alias("_right"))
    return pairs.select("date_utc", F.get("_left", F.lit(0)).alias("left"), F.get("_right", F.lit(0)).alias("right"), F.concat("_left", "_right").alias("at"))


def _correlations(wide: DataFrame, names: list[str], others: list[str], least: int) -> DataFrame:
    """a, b, corr (the absolute mean over dates) of all names with all others that share a date.

    A column is ranked on a date once for each pattern of rows that it meets in the others: one sort
    by (date, patterns, column), however many pairs. Ranks are packed in blocks of a date's rows, and
    products are summed by block, so neither a date nor a column of it has to fit in one task.
    """
    key = F.col("ticker") if "ticker" in wide.columns else F.monotonically_increasing_id()
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = wide.select("date_utc", key.alias("_id"), F.array(*[value(c) for c in [*names, *others]]).alias("_v"))
    meets = F.get("_v", F.col("left")).isNotNull() & F.get("_v", F.col("right")).isNotNull()
    long = rows.join(_meetings(rows, len(names), least), "date_utc").where(meets).select("date_utc", "left", "right", "_id", "_v", F.explode("at").alias("at"))
    pair = ["date_utc", "left", "right"]
    by = Window.partitionBy(*pair, "at")
    up_to = by.orderBy("_x")
    last, n = F.count("*").over(up_to.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.count("*").over(by)
    ranked = long.select(*pair, "at", "_id", F.get("_v", F.col("at")).alias("_x")).select(*pair, "at", "_id", ((F.rank().over(up_to) + last - n - 1) / 2).alias("_z"), n.alias("_n"))
    packed = ranked.where(F.col("_n") >= least).groupBy(*pair, "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("_id", "_z"))), lambda p: p["_z"]).alias("_z"))
    packed = packed.withColumn("_norm", F.sqrt(F.aggregate("_z", F.lit(0.0), lambda s, z: s + z * z))).where(F.col("_norm") > 0)
    parts = packed.select(*pair, "at", "_norm", "_z", F.explode(F.sequence(F.lit(0), F.size("_z") - 1, F.lit(BLOCK))).alias("_from"))
    column = F.struct("at", F.transform(F.slice("_z", F.col("_from") + 1, F.lit(BLOCK)), lambda z: z / F.col("_norm")).alias("z"))
    mine = F.col("at") < len(names)
    blocks = parts.groupBy(*pair, "_from").agg(F.collect_list(F.when(mine, column)).alias("_a"), F.collect_list(F.when(~mine, column)).alias("_b"))
    dot = lambda a, b: F.aggregate(F.zip_with(a["z"], b["z"], lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    products = F.flatten(F.transform("_a", lambda a: F.transform("_b", lambda b: F.struct(a["at"].alias("i"), b["at"].alias("j"), dot(a, b).alias("part")))))
    # each date of a pair of columns has one block from 0 on
    found = blocks.select("_from", F.explode(products).alias("p")).groupBy("p.i", "p.j").agg(F.abs(F.sum("p.part") / F.count(F.when(F.col("_from") == 0, 1))).alias("corr"))
    named = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), k)
    return found.select(named(names, F.col("i")).alias("a"), named(others, F.col("j") - len(names)).alias("b"), "corr")


def signal_correlations(wide: DataFrame, pairs: list[tuple[str, str]], least: int = LEAST) -> DataFrame:
    """a, b, corr: the absolute mean over dates of the rank correlation of two columns of `wide`.

    Pairs are matched first; a date needs `least` of them; NULL if no date has them.
    """
    found = _correlations(wide, list(dict.fromkeys(a for a, _ in pairs)), list(dict.fromkeys(b for _, b in pairs)), least)
    return wide.sparkSession.createDataFrame(pairs, "a string, b string").join(found, ["a", "b"], "left")


def diversity(wide: DataFrame, names: list[str], others: list[str], least: int = LEAST) -> DataFrame:
    """formula, diversity: 1 less the mean correlation with `others`; 1 where none is defined."""
    base = wide.sparkSession.createDataFrame([(n,) for n in names], "formula string")
    if not names or not others:
        return base.withColumn("diversity", F.lit(1.0))
    found = _correlations(wide, names, others, least).groupBy(F.col("a").alias("formula")).agg((1 - F.avg("corr")).alias("diversity"))
    return base.join(found, "formula", "left").select("formula", F.coalesce("diversity", F.lit(1.0)).alias("diversity"))


@dataclass(frozen=True)
class Fitness:
    rank_ic: float
    stability: float
    diversity: float

    @property
    def feasible(self) -> bool:
        return all(v > -99 for v in (self.rank_ic, self.stability, self.diversity))


def composite_fitness(wide: DataFrame, ret: str, names: list[str], others: list[str], return_dates: DataFrame | None = None) -> DataFrame:
    """formula, rank_ic, stability, diversity; the infeasible triple where a signal or all returns are unknown.

    The same where a signal is known on a date that `return_dates` (date_utc), if given, lacks: it
    would look ahead. One batch for any number of formulas: long rows for the information
    coefficients, dates for the diversity.
    """
    own = wide if return_dates is None else wide.join(return_dates.select("date_utc").distinct().withColumn("_dated", F.lit(True)), "date_utc", "left")
    undated = F.lit(False) if return_dates is None else F.col("_dated").isNull()
    counts = own.agg(F.count(ret).alias("_r"), *[F.count(n).alias(n) for n in names], *[F.count(F.when(undated, F.col(n))).alias(f"_ahead_{n}") for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("formula"), F.col(n).alias("known"), F.col(f"_ahead_{n}").alias("ahead")) for n in names])
    known = counts.select("_r", F.explode(pairs).alias("p")).select("_r", "p.*")
    parts = known.join(newey_west(wide_ic(wide, names, ret)), "formula", "left").join(diversity(wide, names, others), "formula", "left")
    good = (F.col("known") > 0) & (F.col("_r") > 0) & (F.col("ahead") == 0)
    return parts.select(
        "formula",
        F.when(good, F.coalesce("mean_ic", F.lit(0.0))).otherwise(INFEASIBLE[0]).alias("rank_ic"),
        F.when(good, F.coalesce("stability", F.lit(0.0))).otherwise(INFEASIBLE[1]).alias("stability"),
        F.when(good, F.coalesce("diversity", F.lit(1.0))).otherwise(INFEASIBLE[2]).alias("diversity"),
    )


def lag_for_series(n: int) -> int:
    return max(1, min(math.floor(4 * (n / 100) ** (2 / 9)), n - 1))


def signal_dates_without_returns(signals: DataFrame, returns: DataFrame) -> DataFrame:
    """Dates of signals that returns lack; any at all is look-ahead."""
    return signals.select("date_utc").distinct().join(returns.select("date_utc").distinct(), "date_utc", "left_anti")


def unlagged_first_rows(panel: DataFrame, column: str) -> DataFrame:
    """Tickers whose first row has a value in a column that must be lagged."""
    first = panel.withColumn("_k", F.row_number().over(C.ticker())).where((F.col("_k") == 1) & F.col(column).isNotNull())
    return first.select(*KEYS)


def outside_envelope(panel: DataFrame, clipped: str, original: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose clipped value lies outside its date's range of original values."""
    low, high = F.min(original).over(C.date()), F.max(original).over(C.date())
    marked = panel.withColumn("_out", (F.col(clipped) < low - tolerance) | (F.col(clipped) > high + tolerance))
    return marked.where("_out").drop("_out")


def check_lookahead(panel: DataFrame, signals: DataFrame, returns: DataFrame, *, name: str = "", column: str | None = None) -> None:
    """Raises LookaheadBiasError if any guard finds a row."""
    if not signal_dates_without_returns(signals, returns).isEmpty():
        raise LookaheadBiasError("signals have dates that returns lack")
    if column and "funding_rate" in name.lower() and not unlagged_first_rows(panel, column).isEmpty():
        raise LookaheadBiasError(f"{column} isn't lagged")
    if {"winsorized", "original"} <= set(panel.columns) and not outside_envelope(panel, "winsorized", "original").isEmpty():
        raise LookaheadBiasError("clipped values lie outside their date's range")
