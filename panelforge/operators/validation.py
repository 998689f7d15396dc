"""Validation of signals: bootstrap, permutation, deflated Sharpe, splits, stability."""

from __future__ import annotations

import math
from datetime import date, timedelta
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ic import LEAST

EULER = 0.5772156649015329
YEAR = 365
#: Pairs that a task counts, which take some 200 bytes each, and the most tasks; beyond both, tasks have more, and spill.
PAIRS_A_TASK, MOST_TASKS = 1 << 21, 4000


def uniform(*parts: Column | int | str) -> Column:
    """A number from 0 to below 1 by an MD5 of the parts: the same in every run, and in SQL."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def bootstrap_means(daily: DataFrame, by: list[str] = ("formula",), *, value: str = "ic", replicates: int = 1000, block: float = 10.0, seed: int = 42) -> DataFrame:
    """by, replicate, mean: means of series drawn anew by the stationary bootstrap.

    A drawn series is blocks: one begins at the first position, and at any other with a probability
    of 1 / `block`, and is the series from a random day on, around its end. So a block's sum is a difference
    of two running sums, and only the rows at which a block begins are shuffled, a tenth of all
    positions of all replicates.
    """
    series = Window.partitionBy(*by)
    in_order = series.orderBy("date_utc")
    at = daily.select(*by, "date_utc", F.col(value).cast("double").alias("_v")).select(
        *by, (F.row_number().over(in_order) - 1).alias("_t"), F.count("*").over(series).alias("_n"), F.sum("_v").over(series).alias("_total"),
        F.coalesce(F.sum("_v").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"),
    )
    many = at.select(*by, "_t", "_n", "_total", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    begun = many.where((F.col("_t") == 0) | (uniform(seed, "anew", F.col("replicate"), F.col("_t")) < 1 / block))
    until = F.lead("_t", 1).over(Window.partitionBy(*by, "replicate").orderBy("_t"))
    begun = begun.withColumn("_from", F.floor(uniform(seed, "from", F.col("replicate"), F.col("_t")) * F.col("_n")).cast("int"))
    blocks = begun.withColumn("_to", F.col("_from") + F.coalesce(until, F.col("_n")) - F.col("_t"))
    sums = lambda t, name: at.select(*by, F.col("_t").alias(t), F.col("_before").alias(name))
    blocks = blocks.withColumn("_end", (F.col("_to") % F.col("_n")).cast("int")).join(sums("_from", "_less"), [*by, "_from"]).join(sums("_end", "_more"), [*by, "_end"])
    own = F.col("_more") - F.col("_less") + F.when(F.col("_to") >= F.col("_n"), F.col("_total")).otherwise(0.0)
    return blocks.groupBy(*by, "replicate").agg((F.sum(own) / F.first("_n")).alias("mean"))


def bootstrap_ci(daily: DataFrame, by: list[str] = ("formula",), *, value: str = "ic", replicates: int = 1000, block: float = 10.0, level: float = 0.95, seed: int = 42) -> DataFrame:
    """by, mean, lower, upper of daily series, by bootstrap_means().

    Fewer than ten dates give nulls, a constant series its mean three times.
    """
    v = F.col(value).cast("double")
    own = daily.groupBy(*by).agg(F.count(v).alias("_n"), F.avg(v).alias("_mean"), (F.min(v) == F.max(v)).alias("_constant"))
    tail = (1 - level) / 2
    limits = bootstrap_means(daily, by, value=value, replicates=replicates, block=block, seed=seed)
    limits = limits.groupBy(*by).agg(F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("_limits"))
    known = F.col("_n") >= 10
    limit = lambda k: F.when(known & F.col("_constant"), F.col("_mean")).when(known, F.get("_limits", F.lit(k)))
    return own.join(limits, list(by)).select(*by, F.when(known, F.col("_mean")).alias("mean"), limit(0).alias("lower"), limit(1).alias("upper"))


def permutation_test(signals: DataFrame, ret: str, *, permutations: int = 100, seed: int = 42) -> DataFrame:
    """observed, p_value: how often returns shuffled within dates correlate as much with the signal.

    `signals` are (date_utc, ticker, x, ret) of one formula. A shuffle is a join: the row that stands
    k-th by an MD5 of the permutation and the key gets the return of the row that is k-th by ticker.
    """
    rows = signals.where(F.col("x").isNotNull() & F.col(ret).isNotNull()).select("date_utc", "ticker", "x", F.col(ret).alias("r"))
    # a shuffle moves ranks but changes none, so a date's rows are ranked once for all permutations
    date = Window.partitionBy("date_utc")
    fixed = rows.select(
        "date_utc", "ticker", C.cs_rank(F.col("x"), date).alias("a"), C.cs_rank(F.col("r"), date).alias("b"), F.row_number().over(date.orderBy("ticker")).alias("_k"), F.count("*").over(date).alias("_n"),
    ).where(F.col("_n") >= LEAST)
    many = fixed.select("date_utc", "ticker", "b", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col("date_utc").cast("string"), "ticker"))
    shuffled = many.withColumn("_k", F.row_number().over(Window.partitionBy("perm", "date_utc").orderBy(key))).select("perm", "date_utc", "_k", "b")
    paired = shuffled.join(fixed.select("date_utc", "_k", "a"), ["date_utc", "_k"])
    means = paired.groupBy("perm", "date_utc").agg(C.safe_corr(F.col("a"), F.col("b")).alias("ic")).groupBy("perm").agg(F.avg("ic").alias("ic")).where("ic is not null")
    observed = fixed.groupBy("date_utc").agg(C.safe_corr(F.col("a"), F.col("b")).alias("ic")).agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("observed"))
    return means.join(F.broadcast(observed)).groupBy("observed").agg((F.sum((F.abs("ic") >= F.abs("observed")).cast("int")) / F.lit(float(permutations))).alias("p_value"))


def deflated_sharpe(sharpe: float, trials: int, n: int, skew: float = 0.0, excess_kurtosis: float = 0.0) -> float:
    """Probability that an annualised Sharpe ratio of `n` returns beats the best of `trials` by chance."""
    if n < 2 or trials < 1:
        return 0.0
    sr = sharpe / math.sqrt(YEAR)
    variance = (1 - skew * sr + (excess_kurtosis + 2) / 4 * sr * sr) / (n - 1)
    if variance <= 0:
        return 0.0
    if trials == 1:
        return 1.0
    normal = NormalDist()
    best = (1 - EULER) * normal.inv_cdf(1 - 1 / trials) + EULER * normal.inv_cdf(1 - 1 / (trials * math.e))
    return normal.cdf(sr / math.sqrt(variance) - best)


def deflated_sharpe_of(daily: DataFrame, trials: int, ret: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, sharpe, skew, kurtosis, dsr of daily series, by their own population moments; a row of moments for each comes to the driver."""
    kinds = "".join(f"`{b}` {dict(daily.dtypes)[b]}, " for b in by)
    got = daily.groupBy(*by).agg(
        F.count(ret).alias("n"), F.avg(ret).alias("m"), F.stddev_pop(ret).alias("s"), F.skewness(ret).alias("skew"), F.kurtosis(ret).alias("kurtosis")
    ).collect()
    rows = []
    for r in got:
        sharpe = r["m"] / r["s"] * math.sqrt(YEAR) if r["n"] >= 2 and r["s"] else 0.0
        skew, kurtosis = r["skew"] or 0.0, r["kurtosis"] or 0.0
        rows.append((*[r[b] for b in by], r["n"], sharpe, skew, kurtosis, deflated_sharpe(sharpe, trials, r["n"], skew, kurtosis)))
    return daily.sparkSession.createDataFrame(rows, kinds + "n long, sharpe double, skew double, kurtosis double, dsr double")


def gaussian_deflated_sharpe(sharpe: float, trials: int, n: int) -> float:
    """deflated_sharpe() of returns taken to be normal."""
    return deflated_sharpe(sharpe, trials, n, 0.0, 0.0)


def gap_alert(inside: float, outside: float, threshold: float = 0.5) -> tuple[bool, float]:
    """Whether the relative drop from in-sample to out-of-sample is above the threshold, and the drop."""
    if inside == 0:
        return abs(outside) > threshold, math.inf
    gap = abs(inside - outside) / abs(inside)
    return gap > threshold, gap


def walk_forward_windows(start: date, end: date, *, inside: int, outside: int, step: int, embargo: int = 7) -> list[tuple[int, date, date, date, date]]:
    """(number, in-sample start and end, out-of-sample start and end), ends excluded.

    The in-sample span must end by `end`; the out-of-sample span may go beyond it.
    """
    if min(inside, outside, step) <= 0 or embargo < 0:
        raise ValueError("spans and steps must be positive, the embargo not negative")
    out, at = [], start
    while end > start and at + timedelta(days=inside) <= end:
        stop = at + timedelta(days=inside)
        first = stop + timedelta(days=embargo)
        out.append((len(out), at, stop, first, first + timedelta(days=outside)))
        at += timedelta(days=step)
    return out


def walk_forward(spark: SparkSession, panel: DataFrame, windows: list[tuple[int, date, date, date, date]]) -> DataFrame:
    """`panel` rows with window_id and segment (is or oos), once for each span that holds their date."""
    spans = [(k, "is", a, b) for k, a, b, _, _ in windows] + [(k, "oos", c, d) for k, _, _, c, d in windows]
    table = spark.createDataFrame(spans, "window_id int, segment string, _from date, _to date")
    inside = (F.col("date_utc") >= F.col("_from")) & (F.col("date_utc") < F.col("_to"))
    return panel.join(F.broadcast(table), inside).drop("_from", "_to")


def purged_splits(n: int, groups: int, test_groups: int, *, purge: int = 0, embargo: int = 0) -> list[tuple[int, list[int], list[int]]]:
    """Combinatorial purged splits of rows 0 to n - 1: (number, training rows, test rows).

    Training rows within `purge` before a test group, or within `embargo` after one, are left out.
    """
    if not 0 < test_groups < groups or n < groups or purge < 0 or embargo < 0:
        raise ValueError("needs 0 < test groups < groups <= rows, and no negative purge or embargo")
    bounds = [i * n // groups for i in range(groups + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(groups), test_groups)):
        train: list[int] = []
        for g in set(range(groups)) - set(chosen):
            a, b = bounds[g], bounds[g + 1]
            if g - 1 in chosen:
                a = min(b, a + embargo)
            if g + 1 in chosen:
                b = max(a, b - purge)
            train += range(a, b)
        out.append((number, sorted(train), [i for g in chosen for i in range(bounds[g], bounds[g + 1])]))
    return out


def split_spans(spark: SparkSession, dates: DataFrame, groups: int, test_groups: int, *, purge: int = 0, embargo: int = 0) -> DataFrame:
    """split_id, group, role, first, last: the rows first to last - 1 that each split takes of each group of dates.

    What is left out are the ends of a training group: `purge` rows before a test group, `embargo`
    rows after one. Splits and groups are parameters, so they bound the table; the number of dates is
    one row.
    """
    if not 0 < test_groups < groups or purge < 0 or embargo < 0:
        raise ValueError("needs 0 < test groups < groups, and no negative purge or embargo")
    rows = [(k, g, g in chosen, g - 1 in chosen, g + 1 in chosen) for k, chosen in enumerate(combinations(range(groups), test_groups)) for g in range(groups)]
    table = spark.createDataFrame(rows, "split_id int, group int, test boolean, after boolean, before boolean")
    total = dates.agg(F.count_distinct("date_utc").alias("n"))
    bound = lambda g: F.floor(g * F.col("n") / groups)
    first, last = bound(F.col("group")), bound(F.col("group") + 1)
    shrunk = table.join(F.broadcast(total)).select(
        "split_id", "group", F.when(F.col("test"), "test").otherwise("train").alias("role"),
        (first + F.when(~F.col("test") & F.col("after"), embargo).otherwise(0)).alias("first"), (last - F.when(~F.col("test") & F.col("before"), purge).otherwise(0)).alias("last"),
    )
    return shrunk.where(F.col("first") < F.col("last"))


def split_dates(dates: DataFrame, groups: int, test_groups: int, *, purge: int = 0, embargo: int = 0) -> DataFrame:
    """split_id, date_utc, role (train or test): the combinatorial purged splits of a table's dates.

    Dates and spans meet by the group that a date is in, which its number tells.
    """
    spans = split_spans(dates.sparkSession, dates, groups, test_groups, purge=purge, embargo=embargo)
    # numbers go over all dates: as many rows as there are dates
    numbered = dates.select("date_utc").distinct().withColumn("i", F.row_number().over(Window.orderBy("date_utc")) - 1)
    n = dates.agg(F.count_distinct("date_utc").alias("_n"))
    grouped = numbered.join(F.broadcast(n)).withColumn("group", F.floor(((F.col("i") + 1) * groups - 1) / F.col("_n")).cast("int"))
    return grouped.join(F.broadcast(spans), "group").where((F.col("i") >= F.col("first")) & (F.col("i") < F.col("last"))).select("split_id", "date_utc", "role")


def split_sizes(spark: SparkSession, dates: DataFrame, groups: int, test_groups: int, *, purge: int, embargo: int) -> DataFrame:
    """split_id, n_train, n_test of the dates of a table."""
    spans = split_spans(spark, dates, groups, test_groups, purge=purge, embargo=embargo)
    size = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("last") - F.col("first"))), F.lit(0)).cast("long")
    return spans.groupBy("split_id").agg(size("train").alias("n_train"), size("test").alias("n_test"))


def split_measures(daily: DataFrame, splits: DataFrame, value: str = "ic", by: tuple[str, ...] = ()) -> DataFrame:
    """by, split_id, role, n, mean, ratio (the mean by its deviation; NULL where that is 0) of daily series over each split's dates, all in one plan."""
    rows = daily.join(splits, "date_utc").groupBy(*by, "split_id", "role")
    return rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.try_divide(F.avg(value), F.nullif(F.stddev_pop(value), F.lit(0.0))).alias("ratio"))


def shared_items(sets: DataFrame) -> DataFrame:
    """i, n_i, j, n_j, both: the pairs of sets of (id, items) that share items, with their sizes and the number shared.

    The sets of an item are one list by size and id, of which each set gets the rest after it; so the
    smaller of two counts. Tasks are as many as pairs ask for, not as the much smaller lists do, so what
    one holds does not grow with the tables. The number of pairs is one row, read first.
    """
    known, n = sets.where("id is not null"), F.col("n")
    items = lambda df: df.select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
    load = items(known).groupBy("item").agg(F.count("*").cast("double").alias("n")).agg(F.sum(n * (n + 1) / 2)).first()[0] or 0.0
    tasks = min(max(math.ceil(load / PAIRS_A_TASK), sets.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)
    lists = items(known.repartition(tasks, "id")).repartition(tasks, "item").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("_all"))
    # sizes and ids as arrays of their own: an array of structs takes three times the room
    each = lists.where(F.size("_all") > 1).select(F.posexplode("_all").alias("_at", "_own"), F.col("_all.id").alias("_ids"), F.col("_all.n").alias("_sizes"))
    rest = lambda c: F.slice(c, F.col("_at") + 2, F.size(c))
    rests = each.where(F.col("_at") + 1 < F.size("_ids")).select(F.col("_own.id").alias("i"), F.col("_own.n").alias("n_i"), rest("_ids").alias("_ids"), rest("_sizes").alias("_sizes"))
    pairs = rests.repartition(tasks, "i").select("i", "n_i", "_sizes", F.posexplode("_ids").alias("_at", "j")).select("i", "n_i", "j", F.get("_sizes", F.col("_at")).alias("n_j"))
    return pairs.where("i != j").groupBy("i", "n_i", "j", "n_j").agg(F.count("*").alias("both"))


def jaccard_stability(sets: DataFrame) -> DataFrame:
    """jaccard: the mean pairwise Jaccard similarity of the sets of (id, items); 0 for fewer than two.

    Pairs come from the items they share, aggregated to one row each; those that share none, and
    pairs of empty sets, add 0. An item that n sets have counts for n (n - 1) / 2 pairs.
    """
    sets = sets.select("id", F.array_compact(F.array_distinct("items")).alias("items"))
    total = shared_items(sets).agg(F.coalesce(F.sum(F.col("both") / (F.col("n_i") + F.col("n_j") - F.col("both"))), F.lit(0.0)).alias("total"))
    n = F.col("n_sets")
    return sets.agg(F.count("*").alias("n_sets")).join(total).select(F.coalesce(F.try_divide(F.col("total"), n * (n - 1) / 2), F.lit(0.0)).alias("jaccard"))


def jaccard_pass(sets: DataFrame, threshold: float = 0.7) -> bool:
    return jaccard_stability(sets).first()["jaccard"] >= threshold
