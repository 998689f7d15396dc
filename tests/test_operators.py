"""Known answers of the panel operators."""

import hashlib
import json
import math
import os
import random
import subprocess
import sys
import tempfile
from datetime import date, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from panelforge.config import Config
from panelforge.functions import columns as C
from panelforge.operators import cleaning, factors, ic, portfolio, validation
from panelforge.operators.panel import BloatLimitExceeded, InvalidFormulaError, LookaheadBiasError
from panelforge.plans import formula as P
from panelforge.plans import runner, search
from panelforge.plans.batch import evaluate
from panelforge.sources import rest, store
from panelforge.sources.probe import first_days
from panelforge.streaming import ingest

DAY = date(2024, 1, 1)


def panel(spark, values, ticker="A"):
    rows = [(DAY + timedelta(days=i), ticker, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date_utc date, ticker string, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("ticker", "date_utc").collect()]


def test_time_series_functions_on_a_ramp(spark):
    got = panel(spark, range(10)).withColumns({"m": C.ts_mean(F.col("x"), 3), "d": C.delta(F.col("x"), 1), "r": C.ts_rank(F.col("x"), 3), "s": C.ts_std(F.col("x"), 3)})
    rows = got.orderBy("date_utc").collect()
    assert [r["m"] for r in rows[:3]] == [None, None, 1.0]
    assert rows[1]["d"] == 1.0 and rows[0]["d"] is None
    assert rows[2]["r"] == 1.0 and rows[1]["r"] is None
    assert rows[5]["s"] == pytest.approx(math.sqrt(2 / 3))


def test_gaps_are_filled_up_to_the_limit_only(spark):
    got = panel(spark, [1, None, None, None, None, 6])
    assert column(cleaning.filled(got, ["x"], 3), "x") == [1, 1, 1, 1, None, 6]
    assert column(cleaning.filled(got, ["x"], 20), "x") == [1, 1, 1, 1, 1, 6]


def test_ranks_share_ties_and_skip_nulls(spark):
    rows = [(DAY, t, v) for t, v in zip("ABCDE", [1.0, 2.0, 2.0, None, 3.0], strict=True)]
    df = spark.createDataFrame(rows, "date_utc date, ticker string, x double").withColumns({"r": C.cs_rank(F.col("x")), "z": C.cs_zscore(F.col("x"))})
    assert column(df, "r") == [0.25, 0.625, 0.625, None, 1.0]
    assert sum(v for v in column(df, "z") if v is not None) == pytest.approx(0)


def test_constant_dates_have_no_zscore_and_all_short_weights(spark):
    df = spark.createDataFrame([(DAY, t, 1.0) for t in "ABCD"], "date_utc date, ticker string, x double")
    assert column(df.withColumn("z", C.cs_zscore(F.col("x"))), "z") == [None] * 4
    assert column(portfolio.with_weights(df, "x"), "weight") == [-0.25] * 4
    assert portfolio.decile_returns(df.withColumn("r", F.lit(0.1)), "x", "r", 4).count() == 0


def test_weights_sum_to_zero(spark):
    rows = [(DAY, f"T{i}", float(i)) for i in range(20)]
    df = portfolio.with_weights(spark.createDataFrame(rows, "date_utc date, ticker string, x double"), "x")
    assert sum(column(df, "weight")) == pytest.approx(0)
    assert sum(abs(w) for w in column(df, "weight")) == pytest.approx(2)


def test_symbols(spark):
    raw = spark.createDataFrame([("btc_usdt",), ("ETH-USDT",), ("SOLUSDT",), ("BNB/USDT",)], "s string")
    assert sorted(r[0] for r in raw.select(cleaning.harmonised_symbol(F.col("s"))).collect()) == ["BNB/USDT", "BTC/USDT", "ETH/USDT", "SOL/USDT"]


def test_formulas_parse_print_and_refuse(spark):
    text = "zscore(delta(ts_std(rank(add(MOM_30D, MOM_7D)), W_30), W_14))"
    tree = P.parse(text)
    assert str(tree) == text and tree.size == 9 and tree.look_back == 29 + 14
    for bad in ("", "rank(", "rank(NOPE)", "add(MOM_1D)", "ts_mean(MOM_1D, W_8)", "rank(MOM_1D) MOM_7D", "MOM_1D; x"):
        with pytest.raises(InvalidFormulaError):
            P.parse(bad)
    with pytest.raises(BloatLimitExceeded):
        P.bounded(tree, 3)


def test_equal_subtrees_are_one_column(spark):
    df = panel(spark, range(40))
    trees = {"a": P.parse("add(ts_mean(x, W_7), ts_mean(x, W_7))", ["x"]), "b": P.parse("rank(ts_mean(x, W_7))", ["x"])}
    out = evaluate(df, trees)
    assert column(out, "a")[6] == 6.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_variation_keeps_the_limits():
    rng = random.Random(3)
    trees = [P.random_tree(rng) for _ in range(60)]
    for a, b in zip(trees, trees[1:], strict=False):
        for child in (*P.crossover(rng, a, b), P.mutate(rng, a), P.mutate_point(rng, a)):
            assert child.size <= max(P.MAX_NODES, a.size, b.size)
            assert P.parse(str(child)) == child
    assert [str(P.random_tree(random.Random(5))) for _ in range(3)] == [str(P.random_tree(random.Random(5))) for _ in range(3)]


def test_fronts_and_selection():
    fit = [ic.Fitness(*v) for v in [(1, 1, 1), (2, 2, 2), (0, 3, 0), (-99, -99, 0), (2, 2, 2)]]
    trees = [P.Node(n) for n in ("MOM_1D", "MOM_7D", "MOM_30D", "OI_USD", "MOM_7D")]
    assert search.pareto(trees, fit) == [1, 2]
    assert 3 not in search.select(trees, fit, 4) and search.select(trees, fit, 5)[-1] == 3


def test_pareto_front_of_a_table(spark):
    rng = random.Random(4)
    rows = [(i, round(rng.random(), 2), round(rng.random(), 2), None if i % 97 == 5 else round(rng.random(), 2)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double").repartition(3)
    beats = lambda x, y: None not in x + y and all(p >= q for p, q in zip(x, y, strict=True)) and x != y
    points = {r[1:] for r in rows}
    expected = sorted(r[0] for r in rows if not any(beats(p, r[1:]) for p in points))
    assert sorted(r["k"] for r in search.pareto_front(df, "k", ["a", "b", "c"]).collect()) == expected


def test_deflated_sharpe_of_a_series(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(0.002, 0.01, 120)
    df = spark.createDataFrame([("f", float(v)) for v in x], "formula string, ret double")
    got = validation.deflated_sharpe_of(df, 50, by=("formula",)).first()
    z = (x - x.mean()) / x.std()
    sharpe = x.mean() / x.std() * math.sqrt(365)
    assert (got["n"], got["sharpe"], got["skew"], got["kurtosis"]) == pytest.approx((120, sharpe, (z**3).mean(), (z**4).mean() - 3))
    assert got["dsr"] == pytest.approx(validation.deflated_sharpe(sharpe, 50, 120, (z**3).mean(), (z**4).mean() - 3))


def test_cache_forgets_the_oldest():
    cache = search.FitnessCache(2)
    for n in ("MOM_1D", "MOM_7D", "MOM_30D"):
        cache.put(P.Node(n), ic.Fitness(0, 0, 0))
    assert len(cache) == 2 and cache.get(P.Node("MOM_1D")) is None


def test_deflated_sharpe():
    assert validation.deflated_sharpe(0.5, 1_000_000, 100) < 0.01
    assert validation.deflated_sharpe(2.0, 5, 500) > 0.5
    assert validation.deflated_sharpe(2.0, 5, 1) == 0 and validation.deflated_sharpe(2.0, 1, 100) == 1.0


def test_gap_alert():
    assert validation.gap_alert(2.0, 0.5)[0] and not validation.gap_alert(2.0, 1.8)[0]
    assert validation.gap_alert(0, 1.0) == (True, math.inf)
    assert validation.gaussian_deflated_sharpe(1.5, 10, 300) == validation.deflated_sharpe(1.5, 10, 300)


@pytest.mark.parametrize("groups, k, n", [(10, 2, 45), (5, 2, 10), (6, 3, 20), (8, 2, 28)])
def test_purged_splits(groups, k, n):
    splits = validation.purged_splits(120, groups, k, purge=3, embargo=2)
    assert len(splits) == n
    assert all(not set(a) & set(b) for _, a, b in splits)


@pytest.mark.parametrize(("n", "groups", "k", "purge", "embargo"), [(120, 6, 2, 7, 3), (61, 5, 1, 0, 0), (23, 7, 3, 4, 2), (10, 10, 2, 1, 1), (37, 4, 3, 50, 50)])
def test_splits_as_a_table_are_those_of_the_lists(spark, n, groups, k, purge, embargo):
    days = [DAY + timedelta(days=3 * d) for d in range(n)]
    df = spark.createDataFrame([(d,) for d in days for _ in range(2)], "date_utc date")
    got = {}
    for r in validation.split_dates(df, groups, k, purge=purge, embargo=embargo).collect():
        got.setdefault((r["split_id"], r["role"]), []).append(days.index(r["date_utc"]))
    lists = validation.purged_splits(n, groups, k, purge=purge, embargo=embargo)
    assert {key: sorted(v) for key, v in got.items()} == {(s, role): rows for s, a, b in lists for role, rows in (("train", a), ("test", b)) if rows}
    sizes = {r["split_id"]: (r["n_train"], r["n_test"]) for r in validation.split_sizes(spark, df, groups, k, purge=purge, embargo=embargo).collect()}
    assert sizes == {s: (len(a), len(b)) for s, a, b in lists}


def test_measures_of_splits(spark):
    days = [DAY + timedelta(days=d) for d in range(12)]
    daily = spark.createDataFrame([(d, float(k)) for k, d in enumerate(days)], "date_utc date, ic double")
    got = {(r["split_id"], r["role"]): (r["n"], r["mean"]) for r in validation.split_measures(daily, validation.split_dates(daily, 3, 1, purge=1)).collect()}
    assert got == {(0, "test"): (4, 1.5), (0, "train"): (8, 7.5), (1, "test"): (4, 5.5), (1, "train"): (7, 41 / 7), (2, "test"): (4, 9.5), (2, "train"): (7, 3.0)}


def test_walk_forward_windows():
    w = validation.walk_forward_windows(date(2023, 1, 1), date(2024, 12, 31), inside=365, outside=90, step=90)
    assert 3 <= len(w) <= 5 and all((c - b).days >= 7 for _, _, b, c, _ in w)
    with pytest.raises(ValueError):
        validation.walk_forward_windows(DAY, DAY, inside=0, outside=1, step=1)


def test_jaccard(spark):
    sets = lambda *xs: spark.createDataFrame(list(enumerate(map(list, xs))), "id int, items array<string>")
    of = lambda *xs: validation.jaccard_stability(sets(*xs)).first()[0]
    assert of("ab", "ab") == 1 and of("ab", "cd") == 0 and of("ab") == 0 and of("", "") == 0
    assert of("abc", "abd", "", "aab") == pytest.approx((2 / 4 + 2 / 3 + 2 / 3) / 6)
    assert validation.jaccard_pass(sets("abcd", "abcd", "abcd")) and not validation.jaccard_pass(sets("ab", "bc"))


def test_jaccard_deals_tasks_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(validation, "PAIRS_A_TASK", 2000, raising=False)
    # two items that all 300 sets have: 44,850 pairs from 900 rows
    sets = spark.range(300).select("id", F.array(F.lit(-1), F.lit(-2), F.col("id")).alias("items"))
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("jaccard", "jaccard")
    try:
        assert validation.jaccard_stability(sets).first()[0] == pytest.approx(0.5)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("jaccard")]
    stages = [tracker.getStageInfo(k) for job in jobs if job for k in job.stageIds]
    assert max(stage.numTasks for stage in stages if stage) >= 44_850 / 2000
    by_task = validation.shared_items(sets).groupBy(F.spark_partition_id()).count().collect()
    assert sum(n for _, n in by_task) == 44_850 and max(n for _, n in by_task) < 6000


def test_shared_items_are_those_of_all_pairs(spark):
    rows = [(f"s{k}", [str(x) for x in range(60) if (x * x + 7 * k) % (k % 5 + 2) == 0]) for k in range(40)] + [("none", []), (None, ["0", "4"]), ("null", None)]
    got = {frozenset(((r["i"], r["n_i"]), (r["j"], r["n_j"]))): r["both"] for r in validation.shared_items(spark.createDataFrame(rows, "id string, items array<string>")).collect()}
    own = [((i, len(x)), set(x)) for i, x in rows if i is not None and x]
    assert got == {frozenset((a, b)): len(x & y) for (a, x), (b, y) in combinations(own, 2) if x & y}


def test_lookahead_guards(spark):
    df = panel(spark, range(3))
    with pytest.raises(LookaheadBiasError):
        ic.check_lookahead(df, df, df.limit(1))
    with pytest.raises(LookaheadBiasError):
        ic.check_lookahead(df, df, df, name="funding_rate_z", column="x")
    ic.check_lookahead(panel(spark, [None, 1, 2]), df, df, name="funding_rate_z", column="x")


def test_constant_coefficients_have_no_stability(spark):
    rows = [("f", DAY + timedelta(days=i), 0.5) for i in range(5)]
    got = ic.newey_west(spark.createDataFrame(rows, "formula string, date_utc date, ic double")).first()
    assert got["stability"] == 0 and got["mean_ic"] == 0.5


def test_store_finds_gaps(spark, tmp_path):
    s = store.MarketStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("BTC", DAY, 1.0), ("BTC", DAY + timedelta(days=2), 2.0)], "symbol string, at date, v double")
    s.store(rows, "funding", at="at")
    s.store(rows, "funding", at="at")
    assert s.load_range("funding", "2024-01-01", "2024-01-01", "BTC").count() == 1
    gaps = s.missing("funding", "2024-01-01", "2024-01-03")
    assert [str(r["day"]) for r in gaps.collect()] == ["2024-01-02"]
    s.mark_empty(gaps, "funding")
    assert s.missing("funding", "2024-01-01", "2024-01-03").count() == 0


def test_filling_stores_what_comes_and_marks_what_does_not(spark, tmp_path):
    s = store.MarketStore(spark, str(tmp_path / "f"))
    s.store(spark.createDataFrame([("BTC", DAY, 1.0)], "symbol string, at date, v double"), "oi", at="at")
    read = lambda days: days.where("day = date '2024-01-02'").select("symbol", F.col("day").alias("at"), F.lit(2.0).alias("v"))
    assert s.fill("oi", "2024-01-01", "2024-01-03", read, at="at") == 2
    assert s.fill("oi", "2024-01-01", "2024-01-03", read, at="at") == 0
    assert s.load_range("oi", "2024-01-01", "2024-01-03").count() == 2


def test_an_empty_store_is_filled(spark, tmp_path):
    s = store.MarketStore(spark, str(tmp_path / "new"))
    assert s.load_range("oi", "2024-01-01", "2024-01-03").count() == 0 and s.availability("oi").count() == 0
    assert s.missing("oi", "2024-01-01", "2024-01-03").count() == 0  # nothing is wanted yet
    calls = []

    def read(days):
        calls.append(sorted((r["symbol"], str(r["day"])) for r in days.collect()))
        return days.where("symbol <> 'NEW' or day = date '2024-01-02'").select("symbol", F.col("day").cast("timestamp").alias("at"), F.lit(2.0).alias("v"))

    assert s.fill("oi", "2024-01-01", "2024-01-02", read, at="at", symbols=["BTC", "ETH"]) == 4
    assert s.fill("oi", "2024-01-01", "2024-01-03", read, at="at", symbols=["BTC", "NEW"]) == 4  # a new symbol, and a new day
    assert calls[1] == [("BTC", "2024-01-03"), ("NEW", "2024-01-01"), ("NEW", "2024-01-02"), ("NEW", "2024-01-03")]
    assert s.fill("oi", "2024-01-01", "2024-01-03", read, at="at", symbols=["BTC", "NEW"]) == 0
    assert s.fill("funding", "2024-01-01", "2024-01-01", read, at="at", symbols=["BTC"]) == 1  # a new source
    assert s.symbol_available("oi", "NEW") and not s.symbol_available("funding", "NEW")
    s.clear_source("oi")
    assert s.availability("oi").count() == 0 and s.availability("funding").count() == 1
    assert not s.exists("u") and s.read("u") is None
    s.write("u", spark.range(3))
    assert s.exists("u") and s.read("u").count() == 3


def test_a_failed_read_marks_nothing(spark, tmp_path):
    s = store.MarketStore(spark, str(tmp_path / "x"))
    with pytest.raises(RuntimeError):
        s.fill("oi", "2024-01-01", "2024-01-02", lambda days: (_ for _ in ()).throw(RuntimeError()), at="at", symbols=["BTC"])
    assert s.missing("oi", "2024-01-01", "2024-01-02", ["BTC"]).count() == 2


def test_spans_are_asked_for_once(spark, tmp_path):
    s = store.MarketStore(spark, str(tmp_path / "s"))
    have = [("BTC", DAY + timedelta(days=d), 1.0) for d in (0, 4, 5)] + [("ETH", DAY + timedelta(days=9), 1.0)]
    s.store(spark.createDataFrame(have, "symbol string, at date, v double"), "oi", at="at")
    asked = []

    def read(spans):
        asked.extend((r["symbol"], (r["first_day"] - DAY).days, (r["last_day"] - DAY).days, r["n_days"]) for r in spans.collect())
        rows = cleaning.span_days(spans, ["symbol"]).where("symbol = 'BTC'")  # nothing for the others
        return rows.select("symbol", F.col("day").alias("at"), F.lit(2.0).alias("v"))

    days = ("2024-01-01", "2024-01-10")
    assert s.fill("oi", *days, read, at="at", symbols=["BTC", "ETH", "NEW"], spans=True) == 7 + 9 + 10
    assert sorted(asked) == [("BTC", 1, 3, 3), ("BTC", 6, 9, 4), ("ETH", 0, 8, 9), ("NEW", 0, 9, 10)]
    assert s.missing_spans("oi", *days, ["BTC", "ETH", "NEW"]).count() == 0 and s.load_range("oi", *days, "BTC").count() == 10
    rows = spark.createDataFrame([("A", DAY), ("A", DAY), ("A", None), ("A", DAY + timedelta(days=1)), ("B", DAY)], "k string, day date")
    assert {(r["k"], r["n_days"]) for r in cleaning.day_spans(rows, ["k"]).collect()} == {("A", 2), ("B", 1)}


def test_first_days_take_few_probes(spark):
    rng = random.Random(2)
    days = {f"S{k:02d}": sorted(rng.sample(range(rng.randrange(300), 400), rng.choice([1, 3, 40]))) for k in range(30)} | {"NONE": [], "LATE": [399], "EARLY": [0, 399]}
    rows = spark.createDataFrame([(s, DAY + timedelta(days=d)) for s, x in days.items() for d in x], "symbol string, day date").persist()
    asked = []

    def probe(spans):
        asked.extend((r["symbol"], r["first_day"], r["last_day"]) for r in spans.collect())
        return spans.join(rows, "symbol").where(F.col("day").between(F.col("first_day"), F.col("last_day")))

    symbols = spark.createDataFrame([(s,) for s in [*days, "EARLY", None]], "symbol string")
    got = {r["symbol"]: r for r in first_days(symbols, probe, "2024-01-01", str(DAY + timedelta(days=399))).collect()}
    assert {s: r["first_day"] for s, r in got.items()} == {s: DAY + timedelta(days=x[0]) if x else None for s, x in days.items()}
    most = math.log2(400 / 7 + 1) + math.log2(400) + 2
    for s, r in got.items():
        assert r["probes"] == sum(a == s for a, _, _ in asked) <= most
    assert got["NONE"]["probes"] <= 7 and all(a <= b for _, a, b in asked)
    assert first_days(symbols.limit(0), probe, "2024-01-01", "2024-02-01").count() == 0


def test_stored_instants_are_unique(spark, tmp_path):
    s = store.MarketStore(spark, str(tmp_path / "d"))
    s.store(spark.createDataFrame([("BTC", DAY, 1.0)] * 3, "symbol string, at date, v double"), "oi", at="at")
    assert s.load_range("oi", "2024-01-01", "2024-01-01").count() == 1


def test_synthetic_panel(spark):
    df = store.synthetic_panel(spark, tickers=5, days=10)
    assert df.count() == 50 and df.select("ticker").distinct().count() == 5
    walk = [math.log(r["close"] / 100) for r in df.orderBy("date_utc", "ticker").collect()]
    steps = [b - a for a, b in zip([0.0, *walk], walk, strict=False)]
    assert max(map(abs, steps)) < 0.1 and max(map(abs, walk)) > 2 * max(map(abs, steps)) / 3  # small steps that add up
    again = store.synthetic_panel(spark, tickers=5, days=10)
    assert sorted(r["close"] for r in again.collect()) == sorted(r["close"] for r in df.collect())


def test_last_known_values_win_by_column(spark):
    schema = "date_utc date, ticker string, close double, volume double, k int"
    a = spark.createDataFrame([(DAY, "A", 1.0, 5.0, 1), (DAY, "B", None, None, 1), (DAY, "C", 3.0, None, 1)], schema)
    b = spark.createDataFrame([(DAY, "A", 2.0, None, 2)], schema)
    got = {r["ticker"]: (r["close"], r["volume"]) for r in cleaning.last_wins([a, b], order="k").collect()}
    assert got == {"A": (2.0, 5.0), "C": (3.0, None)}


def test_residuals_of_overlapping_dummies_are_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for day in range(3):
        for t in range(12 if day else 1):
            rows.append((DAY + timedelta(days=day), f"T{t}", None if t == 3 else float(rng.normal()), *(float(x) for x in rng.integers(0, 2, 3)), 1.0))
    df = spark.createDataFrame(rows, "date_utc date, ticker string, x double, a double, b double, c double, always double")
    got = {(r["date_utc"], r["ticker"]): r["r"] for r in factors.neutralised(df, "x", ["a", "b", "c", "always"], "r").collect()}
    for day in range(3):
        own = [r for r in rows if r[0] == DAY + timedelta(days=day) and r[2] is not None]
        if len(own) < 2:
            assert all(got[r[0], r[1]] is None for r in own)
            continue
        x = np.array([[1, *r[3:]] for r in own])
        y = np.array([r[2] for r in own])
        residual = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert [got[r[0], r[1]] for r in own] == pytest.approx(residual.tolist(), abs=1e-9)
    assert got[DAY + timedelta(days=1), "T3"] is None


def test_pair_correlations_are_those_of_joint_ranks(spark):
    rng = random.Random(8)
    rows = [(DAY + timedelta(days=d), f"T{t:02d}", *(None if rng.random() < 0.1 * d else round(rng.gauss(0, 1), 1) for _ in range(5))) for d in range(5) for t in range(20)]
    wide = spark.createDataFrame(rows, "date_utc date, ticker string, a double, b double, c double, d double, e double")
    pairs = [(x, y) for x in "abc" for y in "cde"]
    got = {(r["a"], r["b"]): r["corr"] for r in ic.signal_correlations(wide, pairs, 10).collect()}
    for x, y in pairs:
        both = wide.select("date_utc", F.lit("f").alias("formula"), F.col(x).alias("x"), F.col(y).alias("r"))
        expected = ic.daily_ic(both, "r", joint=True).agg(F.abs(F.avg("ic"))).first()[0]
        assert got[x, y] == pytest.approx(expected)


def plain_bootstrap(series, replicates, block=10.0, seed=42):
    """Means of the series drawn anew, position by position."""
    def u(*parts):
        return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:13], 16) / 2**52

    n, out = len(series), []
    for k in range(1, replicates + 1):
        total, at = 0.0, 0
        for t in range(n):
            at = int(u("from", k, t) * n) if t == 0 or u("anew", k, t) < 1 / block else (at + 1) % n
            total += series[at]
        out.append(total / n)
    return out


def test_decay_intervals_are_the_bootstraps(spark):
    import numpy as np

    rng = random.Random(5)
    rows = [("f", DAY + timedelta(days=d), f"T{t:02d}", rng.gauss(0, 1), rng.gauss(0, 1)) for d in range(25) for t in range(12)]
    df = spark.createDataFrame(rows, "formula string, date_utc date, ticker string, x double, r double")
    got = {r["horizon"]: r for r in ic.ic_decay_ci(df, "r", [1, 3, 20, 30]).collect()}
    plain = {r["horizon"]: r["ic"] for r in ic.ic_decay(df, "r", [1, 3, 20, 30]).collect()}
    for h in (1, 3):
        series = [r["ic"] for r in ic.horizon_ic(df, "r", [h]).orderBy("date_utc").collect()]
        assert (got[h]["mean"], got[h]["lower"], got[h]["upper"]) == pytest.approx((np.mean(series), *np.percentile(plain_bootstrap(series, 200), [2.5, 97.5])))
        assert plain[h] == pytest.approx(np.mean(series))
    assert got[20]["lower"] == got[20]["upper"] == got[20]["mean"] == pytest.approx(plain[20])  # five dates
    assert tuple(got[30][k] for k in ("mean", "lower", "upper")) == (0, 0, 0)


@pytest.mark.parametrize("block", [1.0, 3.0, 10.0, 1e9])
def test_drawn_series_have_the_means_of_plain_python(spark, block):
    rng = random.Random(8)
    series = {"a": [rng.gauss(0, 1) for _ in range(40)], "b": [rng.gauss(0, 1) for _ in range(11)], "c": [2.5]}
    df = spark.createDataFrame([(k, DAY + timedelta(days=d), v) for k, x in series.items() for d, v in enumerate(x)], "formula string, date_utc date, ic double")
    got = {}
    for r in validation.bootstrap_means(df, replicates=30, block=block, seed=7).collect():
        got.setdefault(r["formula"], {})[r["replicate"]] = r["mean"]
    for k, x in series.items():
        assert [got[k][i] for i in range(1, 31)] == pytest.approx(plain_bootstrap(x, 30, block, 7))


def test_intervals_cover_the_mean_and_widen_with_the_level(spark):
    rng = random.Random(9)
    rows = [("noise", DAY + timedelta(days=d), rng.gauss(0.1, 0.2)) for d in range(60)] + [("flat", DAY + timedelta(days=d), 0.25) for d in range(12)] + [("short", DAY, 0.5)]
    df = spark.createDataFrame(rows, "formula string, date_utc date, ic double")
    wide, narrow = ({r["formula"]: r for r in validation.bootstrap_ci(df, replicates=200, level=x).collect()} for x in (0.95, 0.5))
    assert wide["noise"]["lower"] < narrow["noise"]["lower"] < wide["noise"]["mean"] < narrow["noise"]["upper"] < wide["noise"]["upper"]
    assert (wide["flat"]["mean"], wide["flat"]["lower"], wide["flat"]["upper"]) == (0.25, 0.25, 0.25) and wide["short"]["mean"] is wide["short"]["lower"] is None
    assert validation.bootstrap_ci(df.limit(0)).count() == 0


def test_spans_of_windows_start_without_turnover(spark):
    rng = random.Random(2)
    rows = [(DAY + timedelta(days=d), f"T{t:02d}", rng.gauss(0, 1), rng.gauss(0, 0.01)) for d in range(30) for t in range(10)]
    df = spark.createDataFrame(rows, "date_utc date, ticker string, s double, r double")
    windows = validation.walk_forward_windows(DAY, DAY + timedelta(days=30), inside=10, outside=5, step=10, embargo=1)
    by = ("window_id", "segment")
    spans = portfolio.with_weights(validation.walk_forward(spark, df, windows), "s", by=by)
    got = {(*[r[b] for b in by], r["date_utc"]): r["net"] for r in portfolio.net_returns(spans, "weight", "r", 10.0, by=by).collect()}
    for k, a, b, c, e in windows:
        for segment, x, y in (("is", a, b), ("oos", c, e)):
            alone = df.where(F.col("date_utc").between(F.lit(x), F.lit(y - timedelta(days=1))))
            for r in portfolio.net_returns(portfolio.with_weights(alone, "s"), "weight", "r", 10.0).collect():
                assert got.pop((k, segment, r["date_utc"])) == pytest.approx(r["net"])
    assert not got


def test_streamed_days_equal_batch_days(spark, tmp_path):
    rows = [("A", f"2024-01-0{d} 0{h}:00:00", float(10 * d + h)) for d in (1, 2, 3) for h in (1, 5)] + [("A", "2024-01-09 00:00:00", 0.0)]
    df = spark.createDataFrame(rows, "s string, at string, v double").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.daily_last_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), symbol="s", at="at", value="v")
    ingest.start(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(60)
    got = {str(r["date_utc"]): r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: got[k] for k in ("2024-01-01", "2024-01-02", "2024-01-03")} == {"2024-01-01": 15.0, "2024-01-02": 25.0, "2024-01-03": 35.0}


def test_search_is_seeded(spark):
    from panelforge.operators.factors import FACTORS

    rng = random.Random(1)
    rows = [(DAY + timedelta(days=d), f"T{t:02d}", rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for d in range(12) for t in range(12)]
    df = spark.createDataFrame(rows, "date_utc date, ticker string, MOM_1D double, VOL_30D double, r double").persist()
    names = [n for n in FACTORS if n in ("MOM_1D", "VOL_30D")]
    run = lambda: [str(t) for t, _ in search.Search(df, "r", population=4, generations=1, names=names, seed=9).run()]
    assert run() == run()


def noise_panel(spark, days=14, tickers=12):
    rng = random.Random(1)
    rows = [(DAY + timedelta(days=d), f"T{t:02d}", rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for d in range(days) for t in range(tickers)]
    return spark.createDataFrame(rows, "date_utc date, ticker string, MOM_1D double, VOL_30D double, r double").persist()


def test_a_formula_that_fails_is_alone_infeasible(spark):
    rng = random.Random(4)
    good = list(dict.fromkeys(P.random_tree(rng, 1, 2, ["MOM_1D", "VOL_30D"]) for _ in range(90)))[:49]
    bad = P.Node("rank", (P.Node("NOT_THERE"),))
    s = search.Search(noise_panel(spark), "r")
    batches, inner = [], s._batch
    s._batch = lambda part, against: batches.append(len(part)) or inner(part, against)
    got = s.score([*good[:20], bad, *good[20:]], [P.Node("MOM_1D")])
    assert got[20] == ic.Fitness(*ic.INFEASIBLE) and s.failed == {bad} and s.cache.get(bad) == got[20]
    assert len(batches) == 1 + 2 * 6 or len(batches) == 1 + 2 * 5  # halves of 50 down to one
    alone = search.Search(s.panel, "r").score(good, [P.Node("MOM_1D")])
    flat = lambda fs: [v for f in fs for v in (f.rank_ic, f.stability, f.diversity)]
    assert flat(got[:20] + got[21:]) == pytest.approx(flat(alone))
    # what failed isn't one of the others, and isn't tried again
    n = len(batches)
    assert s.score([P.parse("rank(rank(rank(MOM_1D)))"), bad], [bad, good[0]])[0].feasible and len(batches) == n + 1


def test_one_that_fails_while_it_runs(spark, monkeypatch):
    from panelforge.plans import batch

    monkeypatch.setitem(batch.BY_DATE, "winsor", lambda x: F.raise_error(F.lit("no such thing")).cast("double"))
    s = search.Search(noise_panel(spark), "r")
    got = s.score([P.parse("rank(MOM_1D)"), P.parse("winsor(MOM_1D)"), P.parse("zscore(MOM_1D)")], [P.Node("VOL_30D")])
    assert [f.feasible for f in got] == [True, False, True]
    assert len(s.store) == 2


def test_a_lost_panel_is_no_formulas_fault(spark):
    panel = noise_panel(spark).withColumn("MOM_1D", F.raise_error(F.lit("gone")).cast("double"))
    with pytest.raises(Exception, match="gone"):
        search.Search(panel, "r").score([P.parse("rank(MOM_1D)")], [])


def test_later_generations_compute_new_nodes_only(spark):
    s = search.Search(noise_panel(spark), "r")
    first = [P.parse(t) for t in ("rank(ts_mean(MOM_1D, W_7))", "zscore(add(MOM_1D, VOL_30D))")]
    s.score(first, [P.Node("MOM_1D")])
    assert s.store.computed == 4 and len(s.store) == 4
    second = [P.parse(t) for t in ("winsor(ts_mean(MOM_1D, W_7))", "zscore(ts_mean(MOM_1D, W_7))", "mul(VOL_30D, zscore(add(MOM_1D, VOL_30D)))")]
    got = s.score(second, first)
    assert s.store.computed == 7  # one each; the others' own columns are there
    s.score([P.parse("ts_mean(MOM_1D, W_7)")], second)
    assert s.store.computed == 7
    fresh = search.Search(s.panel, "r").score(second, first)
    flat = lambda fs: [v for f in fs for v in (f.rank_ic, f.stability, f.diversity)]
    assert flat(got) == pytest.approx(flat(fresh))
    paths = os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    s.store.clear()
    assert len(s.store) == 0 and len(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))) == len(paths) - 1


def test_the_store_forgets_what_was_used_longest_ago(spark):
    store = search.SubtreeStore(noise_panel(spark), "r", most=3)
    a, b, c = (P.parse(t) for t in ("rank(MOM_1D)", "zscore(winsor(MOM_1D))", "rank(VOL_30D)"))
    store.columns([a])
    store.columns([b])
    store.columns([a])
    assert store.computed == 3
    store.columns([c])  # in place of winsor(MOM_1D)
    store.columns([a, b])
    assert store.computed == 4 and len(store) == 3
    got = store.columns([b, c, P.Node("MOM_1D")])
    assert got.columns == ["date_utc", "ticker", "r", *map(store.name, (b, c)), "MOM_1D"] and got.count() == 14 * 12
    d = P.parse("winsor(MOM_1D)")
    store.columns([d])
    assert store.computed == 5 and len(store) == 3


def fake_fetch(symbol, cursor):
    at = cursor or 0
    return [{"t": at + i, "v": float(i)} for i in range(3)], (at + 3 if at < 6 else None)


def test_paged_source_has_a_partition_for_each_symbol(spark):
    spark.dataSource.register(rest.PagedSource)
    df = spark.read.format("paged").schema("symbol string, t long, v double").option("fetcher", "tests.test_operators:fake_fetch").option("symbols", "A,B").load()
    assert df.count() == 18 and df.rdd.getNumPartitions() == 2


def test_retries_wait_as_they_should():
    waits, left = [], [rest.TransientError(status=429), rest.TransientError(retry_after=500)]

    def flaky():
        if left:
            raise left.pop(0)
        return 7

    assert rest.Retry(sleep=waits.append).call(flaky) == 7 and waits == [30.0, 60.0]
    with pytest.raises(rest.TransientError):
        rest.Retry(attempts=1).call(lambda: (_ for _ in ()).throw(rest.TransientError()))


def test_configuration():
    c = Config.of({"seed": 3, "search": {"population": 4}})
    assert (c.seed, c.search.population, c.backtest.horizon) == (3, 4, 7)
    with pytest.raises(KeyError):
        Config.of({"search": {"nope": 1}})


def test_formulas_that_look_ahead_are_infeasible(spark):
    rng = random.Random(1)
    rows = [(DAY + timedelta(days=d), f"T{t:02d}", rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for d in range(14) for t in range(12)]
    df = spark.createDataFrame(rows, "date_utc date, ticker string, MOM_1D double, VOL_30D double, r double")
    days = df.select("date_utc").distinct()
    trees = [P.parse("rank(MOM_1D)"), P.parse("ts_mean(VOL_30D, W_7)")]
    ok = search.Search(df, "r", return_dates=days).score(trees, [P.Node("MOM_1D")])
    assert all(f.feasible for f in ok)
    early = search.Search(df, "r", return_dates=days.where(F.col("date_utc") > F.lit(DAY))).score(trees, [P.Node("MOM_1D")])
    assert [f.feasible for f in early] == [False, True]  # the mean over seven days isn't known on the first


def test_children_are_scored_against_the_whole_population(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(search.Search, "score", lambda self, trees, others: seen.append(len(others)) or [ic.Fitness(0.1, 0.1, 0.1)] * len(trees))
    search.Search(None, "r", population=40, generations=2).run()
    assert seen == [16, 40, 40]


def test_settings_reach_the_run(spark, sf):
    from panelforge.operators.panel import brand_panel

    c = Config.of({"data": {"start": "1996-01-01", "end": "1996-12-31", "universe_size": 6, "max_gap": 1}})
    got = runner.prepared(brand_panel(spark, sf), c)
    days = got.agg(F.min("date_utc"), F.max("date_utc"), F.count_distinct("ticker")).first()
    assert str(days[0]) >= "1996-01-01" and str(days[1]) <= "1996-12-31" and days[2] == 6
    assert ic.unlagged_first_rows(got, "funding_rate").isEmpty()
    unlagged = runner.prepared(brand_panel(spark, sf), Config.of({"data": {"funding_lag": 0}}))
    with pytest.raises(LookaheadBiasError):
        runner.find(unlagged, Config())


def test_the_whole_run_writes_its_reports(spark, tmp_path):
    from panelforge.__main__ import main

    (tmp_path / "c.yaml").write_text("data: {start: '2023-01-01', end: '2023-12-31', is_end: '2023-08-01', universe_size: 30}\nsearch: {population: 4, generations: 1, names: [MOM_1D, VOL_30D]}\n"
                                     "backtest: {is_days: 60, oos_days: 20, step_days: 30, replicates: 50}\n")
    main(["--synthetic", "--config", str(tmp_path / "c.yaml"), "--output", str(tmp_path / "out"), "--seed", "3"], spark)
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / "out" / name))
    front, report = read("pareto_front.csv"), read("diagnostics.csv")
    assert front.columns == ["formula", "f1_rank_ic", "f2_stability", "f3_diversity"] and front.count() == report.count() == read("full_report.csv").count() > 0
    assert {"ic_1d", "ic_7d", "ic_30d", "ic_ci_lower", "ic_ci_upper", "dsr_pvalue", "is_oos_gap", "gap_alert"} <= set(report.columns)
    meta = json.loads(spark.read.text(str(tmp_path / "out" / "meta.json")).first()[0])
    assert meta["seed"] == 3 and meta["pop_size"] == 4 and len(meta["config_hash"]) == 16 and "net" in meta["units"]["returns"]


def test_an_empty_report_has_no_metadata(spark, tmp_path):
    store.write_front(spark, [], str(tmp_path / "o"), {"seed": 1})
    assert not store.path_exists(spark, str(tmp_path / "o" / "meta.json"))


def test_queries_without_the_optional_part():
    """Where one of its dependencies is absent, the other queries are served."""
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['{0}'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for absent in ("zstandard", "panelforge.llm"):
        out = subprocess.run([sys.executable, "-c", code.format(absent)], capture_output=True, text=True, cwd=root, check=True).stdout.split()
        assert int(out[0]) > 90 and out[1] == "False" and int(out[2]) > 80


def test_measures_of_given_formulas(spark, sf):
    from panelforge.operators.panel import brand_panel

    front = [(P.parse("zscore(MOM_7D)"), ic.Fitness(0.1, 1.0, 1.0))]
    got = runner.measure(brand_panel(spark, sf), front, Config())
    row = got.report.first()
    assert row["formula"] == "zscore(MOM_7D)" and row["max_drawdown"] <= 0 and 0 <= row["dsr_pvalue"] <= 1
    assert got.returns.count() > 300
    # several formulas in one plan give what each gives alone
    more = [*front, (P.parse("rank(LS_RATIO)"), ic.Fitness(0.2, 1.0, 1.0))]
    both = {r["formula"]: r for r in runner.measure(brand_panel(spark, sf), more, Config()).report.collect()}
    assert list(both["zscore(MOM_7D)"])[1:] == pytest.approx(list(row)[1:], nan_ok=True)


REPORT = ["formula", "rank_ic", "stability", "diversity", "sharpe", "max_drawdown", "turnover", "ic_1d", "ic_7d", "ic_30d", "ic_ci_lower", "ic_ci_upper", "dsr_pvalue", "is_oos_gap", "gap_alert"]


def test_a_report_row_is_that_of_the_panel(spark, sf):
    """Every measure of a formula with gaps, from the panel's rows by pandas."""
    import numpy as np
    import pandas as pd

    from panelforge.operators import factors
    from panelforge.operators.panel import brand_panel
    from panelforge.plans.batch import evaluate

    tree, c = P.parse("rank(LS_RATIO)"), Config()
    result = runner.measure(brand_panel(spark, sf), [(tree, ic.Fitness(0.2, 1.0, 1.0))], c)
    assert result.report.columns == REPORT
    got = result.report.first()
    wide = evaluate(runner.labelled(factors.with_factors(brand_panel(spark, sf)), 7), {"x": tree})
    rows = wide.select("date_utc", "ticker", "x", "fwd", "fwd_1").toPandas().sort_values(["ticker", "date_utc"])

    def rank_ic(x, r, joint=True):
        out = {}
        for day, g in pd.DataFrame({"d": rows["date_utc"], "x": x, "r": r}).groupby("d"):
            both = g.dropna()
            if joint:
                a, b, enough = both["x"].rank(), both["r"].rank(), len(both) >= 10
            else:
                a, b, enough = g["x"].rank()[both.index], g["r"].rank()[both.index], g["x"].count() >= 10
            if enough and a.std() and b.std():
                out[day] = np.corrcoef(a, b)[0, 1]
        return pd.Series(out, dtype=float).sort_index()

    def interval(series):
        return tuple(np.percentile(plain_bootstrap(list(series), c.backtest.replicates), [2.5, 97.5])) if len(series) >= 10 else (None, None)

    lower, upper = interval(rank_ic(rows["x"], rows["fwd"]))
    assert (got["ic_ci_lower"], got["ic_ci_upper"]) == (lower, upper) or (got["ic_ci_lower"], got["ic_ci_upper"]) == pytest.approx((lower, upper))
    for h in (1, 7, 30):
        far = rank_ic(rows["x"], rows.groupby("ticker")["fwd"].shift(-h), joint=False)
        assert got[f"ic_{h}d"] == pytest.approx(far.mean() if len(far) else 0.0)
    by = rows.groupby("date_utc")["x"]
    up, down = rows["x"] >= by.transform(lambda v: v.quantile(0.9)), rows["x"] <= by.transform(lambda v: v.quantile(0.1))
    rows["up"], rows["down"] = up, down
    n_up, n_down = (rows.groupby("date_utc")[k].transform("sum") for k in ("up", "down"))
    rows["w"] = np.where(down, -1 / n_down.clip(lower=1), np.where(up, 1 / n_up.clip(lower=1), 0.0))
    rows["k"] = rows["date_utc"].rank(method="dense")
    last = rows.groupby("ticker")[["k", "w"]].shift(1)
    rows["moved"] = np.where(last["k"] == rows["k"] - 1, (rows["w"] - last["w"]).abs(), np.nan)
    daily = rows.assign(p=rows["w"] * rows["fwd_1"]).groupby("date_utc")[["p", "moved"]].sum()
    net = daily["p"] - daily["moved"] * c.backtest.cost_bps / 1e4
    sharpe = net.mean() / net.std(ddof=0) * math.sqrt(365)
    curve = (1 + net).cumprod()
    assert (got["sharpe"], got["turnover"]) == pytest.approx((sharpe, daily["moved"].mean()))
    assert got["max_drawdown"] == pytest.approx((curve / curve.cummax() - 1).min())
    centred = net - net.mean()
    skew, kurtosis = (centred**3).mean() / net.std(ddof=0) ** 3, (centred**4).mean() / net.std(ddof=0) ** 4 - 3
    assert got["dsr_pvalue"] == pytest.approx(validation.deflated_sharpe(sharpe, 100 * 50 + 1, len(net), skew, kurtosis))
    assert [(r["formula"], r["horizon"]) for r in result.decay.orderBy("horizon").collect()] == [(str(tree), h) for h in c.backtest.decay_horizons]


def test_the_interval_is_that_of_pairs_matched_first(spark):
    """Where a signal has gaps, ranks within the pairs differ from ranks over all; the report takes the former."""
    from panelforge.plans.batch import evaluate  # noqa: F401

    rng = random.Random(3)
    rows = [(DAY + timedelta(days=d), f"T{t:02d}", *[rng.gauss(0, 1) for _ in range(2)]) for d in range(40) for t in range(24)]
    rows = [(d, t, x if rng.random() < 0.7 else None, r if rng.random() < 0.7 else None) for d, t, x, r in rows]
    df = spark.createDataFrame(rows, "date_utc date, ticker string, x double, fwd double").withColumn("formula", F.lit("f"))
    one, other = (validation.bootstrap_ci(ic.daily_ic(df, "fwd", joint=j), replicates=100).first() for j in (True, False))
    assert one["lower"] != pytest.approx(other["lower"], abs=1e-4)


def test_revision_of_a_checkout(tmp_path):
    assert store.revision(str(tmp_path)) == "unknown"
    run = lambda *args: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *args], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.strip()
    run("init", "-q")
    assert store.revision(str(tmp_path)) == "unknown"
    run("commit", "--allow-empty", "-qm", "x")
    assert store.revision(str(tmp_path)) == run("rev-parse", "HEAD")


def test_tournaments_prefer_fit_and_small_trees():
    trees = [P.parse("MOM_1D"), P.parse("rank(rank(MOM_1D))")]
    won = search.double_tournament(random.Random(1), trees, [ic.Fitness(1, 0, 0), ic.Fitness(0, 0, 0)], 200)
    assert won.count(0) > 150


def test_products_are_summed_over_blocks_of_rows(spark, monkeypatch):
    rng = random.Random(18)
    rows = [(DAY + timedelta(days=d), f"T{t:02d}", *(None if rng.random() < (0.3 if k == 3 else 0.0) else float(rng.randint(0, 6)) for k in range(4)), float("nan")) for d in range(3) for t in range(23)]
    wide = spark.createDataFrame(rows, "date_utc date, ticker string, a double, b double, c double, d double, e double")
    whole = {(r["a"], r["b"]): r["corr"] for r in ic.signal_correlations(wide, [("a", "c"), ("b", "d"), ("a", "d"), ("a", "e")]).collect()}
    monkeypatch.setattr(ic, "BLOCK", 5)
    parts = {(r["a"], r["b"]): r["corr"] for r in ic.signal_correlations(wide.drop("ticker"), [("a", "c"), ("b", "d"), ("a", "d"), ("a", "e")]).collect()}
    assert whole["a", "e"] is None and whole == {k: v if v is None else pytest.approx(v) for k, v in parts.items()}
    plan = ic.diversity(wide, ["a", "b"], ["c", "d"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    # a constant column has no correlation with any
    flat = wide.withColumn("flat", F.lit(1.0))
    assert ic.diversity(flat, ["flat", "a"], ["a"]).where("formula = 'flat'").first()["diversity"] == 1.0


def brute_fronts(points):
    left, out, front = dict(points), {}, 0
    while left:
        front += 1
        own = [k for k, x in left.items() if None in x or not any(None not in y and all(a >= b for a, b in zip(y, x)) and y != x for y in left.values())]
        out |= dict.fromkeys(own, front)
        left = {k: x for k, x in left.items() if k not in own}
    return out


@pytest.mark.parametrize("block", [20_000, 7])
def test_fronts_of_a_table_are_those_of_peeling(spark, monkeypatch, block):
    monkeypatch.setattr(search, "FRONT_BLOCK", block)  # of 7, a front takes several blocks
    rng = random.Random(19)
    points = {f"k{i:02d}": (float(rng.randint(0, 6)), float(rng.randint(0, 6)), rng.random()) for i in range(45)} | {"x": (1.0, None, 0.5), "y": (0.0, 0.0, 0.0)}
    points |= {"same1": points["k00"], "same2": points["k00"]}
    points |= {f"line{i}": (10.0 + i, 30.0 - i, 5.0) for i in range(15)}  # none of these dominates another
    df = spark.createDataFrame([(k, *v) for k, v in points.items()], "k string, a double, b double, c double").repartition(3)
    first = {r["k"] for r in search.pareto_front(df, "k", ["a", "b", "c"]).collect()}
    expected = brute_fronts(points)
    assert first == {k for k, f in expected.items() if f == 1}
    if block == 7:
        return
    got = {r["k"]: r for r in search.ranked_fronts(df, "k", ["a", "b", "c"]).collect()}
    assert {k: r["front"] for k, r in got.items()} == expected
    two = {r["k"]: r["front"] for r in search.ranked_fronts(df, "k", ["a", "b", "c"], most=2).collect()}
    assert two == {k: f if f <= 2 else None for k, f in expected.items()}
    # ties go by the key, so the arrays are in its order
    for f in set(expected.values()):
        own = sorted(k for k, x in expected.items() if x == f and None not in points[k])
        if f > 1:
            import numpy as np

            assert [got[k]["crowding"] for k in own] == pytest.approx(list(search.crowding(np.array([points[k] for k in own]))))
    assert search.ranked_fronts(df.limit(0), "k", ["a", "b", "c"]).count() == 0


def records_of(symbol):
    """Every 3 ms a record, and several at some times."""
    return [{"t": t, "v": float(100 * k + t), "symbol": symbol} for t in range(0, 400, 3) for k in range(7 if t % 60 == 0 else 1)]


#: Tells tasks, which don't see the test's environment, where to log their requests.
WHERE = os.path.join(tempfile.gettempdir(), f"pages-log-{os.getuid()}")


def ascending_pages(symbol, first, last):
    folder = open(WHERE).read() if os.path.exists(WHERE) else ""
    if folder:
        with open(f"{folder}/{symbol}-{first}-{last}", "a"):
            pass
        if os.path.exists(f"{folder}/fail") and symbol == "B" and last >= 250:
            raise RuntimeError("the source is down")
    return [r for r in records_of(symbol) if first <= r["t"] <= last][:10]


def descending_pages(symbol, first, last):
    return [r for r in records_of(symbol)[::-1] if first <= r["t"] <= last][:10]


@pytest.mark.parametrize("descending", [False, True])
def test_pages_of_a_window_give_each_record_once(descending):
    fetch = descending_pages if descending else ascending_pages
    for first, last in ((0, 400), (60, 60), (61, 119), (500, 600), (10, 5), (59, 181)):
        got = list(rest.window(fetch, "A", first, last, descending=descending))
        expected = [r for r in records_of("A") if first <= r["t"] <= last]
        assert sorted(map(str, got)) == sorted(map(str, expected))
    assert list(rest.window(lambda s, a, b: [], "A", 0, 9)) == []
    # a time that fills its page can give no more than that, and doesn't stop the rest
    full = lambda s, a, b: [r for r in ({"t": t, "k": k} for t in (1, 2) for k in range(5)) if a <= r["t"] <= b][:3]
    assert [r["t"] for r in rest.window(full, "A", 0, 9)] == [1, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("order", ["ascending", "descending"])
def test_a_stream_that_fails_goes_on_without_doubles(spark, tmp_path, request, order):
    log = tmp_path / "log"
    log.mkdir()
    with open(WHERE, "w") as file:
        file.write(str(log))
    request.addfinalizer(lambda: os.unlink(WHERE))
    spark.dataSource.register(rest.PagedStream)
    fetcher = f"tests.test_operators:{order}_pages"

    def run(until, symbols="A,B"):
        options = {"fetcher": fetcher, "symbols": symbols, "until": until, "step": 100, "order": order}
        stream = spark.readStream.format("paged_stream").schema("symbol string, t long, v double").options(**options).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    def rows():
        return sorted((r["symbol"], r["t"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    def expected(until, symbols="AB"):
        return sorted((s, r["t"], r["v"]) for s in symbols for r in records_of(s) if r["t"] < until)

    run(150)
    assert rows() == expected(150)
    if order == "ascending":
        (log / "fail").touch()
        with pytest.raises(Exception, match="down"):
            run(400)
        assert rows() == expected(150)  # nothing of the batch that failed
        asked = set(os.listdir(log))
        (log / "fail").unlink()
    run(400)
    assert rows() == expected(400)
    if order == "ascending":
        again = [f for f in set(os.listdir(log)) - asked if f.startswith("B")]
        assert again and all(int(f.split("-")[1]) >= 150 for f in again)  # what was read isn't read again
    run(400, "A,B,C")  # a symbol that is new
    assert rows() == expected(400, "ABC")
    with pytest.raises(Exception, match="order"):
        spark.readStream.format("paged_stream").schema("t long").options(fetcher=fetcher, order="x").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination(30)


def test_two_writers_and_one_that_fails(spark, tmp_path):
    s = store.VersionedStore(spark, str(tmp_path / "v"))
    rows = lambda *x: spark.createDataFrame([(n, DAY + timedelta(days=d), v) for n, d, v in x], "symbol string, at date, v double")
    read = lambda: sorted((r["symbol"], (r["day"] - DAY).days, r["v"]) for r in s.load_range("oi", "2024-01-01", "2024-01-31").collect())
    assert read() == [] and s.versions() == [] and s.vacuum() == 0
    s.store(rows(("BTC", 0, 1.0), ("BTC", 1, 1.0), ("ETH", 0, 1.0)), "oi", at="at")
    # two that write at once: days of either, and one of both, of which the later one's rows count
    a = s.prepare(rows(("BTC", 1, 2.0), ("BTC", 2, 2.0)), "oi", at="at")
    b = s.prepare(rows(("BTC", 2, 3.0), ("SOL", 0, 3.0)), "oi", at="at")
    before = [("BTC", 0, 1.0), ("BTC", 1, 1.0), ("ETH", 0, 1.0)]
    assert read() == before
    s._publish(b)
    assert read() == sorted([*before, ("BTC", 2, 3.0), ("SOL", 0, 3.0)])
    s._publish(a)
    after = [("BTC", 0, 1.0), ("BTC", 1, 2.0), ("BTC", 2, 2.0), ("ETH", 0, 1.0), ("SOL", 0, 3.0)]
    assert read() == after and s.versions()[-2:] == [b, a]
    # one that fails halfway leaves nothing that is read, and doesn't hinder the next
    bad = rows(("BTC", 0, 9.0), ("BTC", 3, 9.0)).withColumn("v", F.when(F.col("at") > F.lit(DAY), F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        s.store(bad, "oi", at="at")
    s.prepare(rows(("BTC", 0, 9.0)), "oi", at="at")
    assert read() == after and s.vacuum() >= 1 and read() == after
    assert s.fill("oi", "2024-01-01", "2024-01-04", lambda days: days.select("symbol", F.col("day").alias("at"), F.lit(4.0).alias("v")), at="at", symbols=["BTC"]) == 1
    assert ("BTC", 3, 4.0) in read() and s.missing("oi", "2024-01-01", "2024-01-04", ["BTC"]).count() == 0
    assert {r["symbol"]: r["n_rows"] for r in s.availability("oi").collect()} == {"BTC": 4, "ETH": 1, "SOL": 1}
    assert s.symbol_available("oi", "SOL") and not s.symbol_available("oi", "XRP")
    s.store(rows(("BTC", 0, 5.0)), "funding", at="at")
    s.clear_source("oi")
    assert read() == [] and s.availability("funding").count() == 1


def test_versions_of_one_number_have_one_order(spark, tmp_path):
    s = store.VersionedStore(spark, str(tmp_path / "v"))
    rows = lambda v: spark.createDataFrame([("A", DAY, v)], "symbol string, at date, v double")
    ids = {s.prepare(rows(v), "oi", at="at"): v for v in (1.0, 2.0)}
    (tmp_path / "v" / "versions").mkdir()
    for c in ids:  # as if neither had seen the other's
        (tmp_path / "v" / "versions" / f"{1:012d}-{c}").touch()
    assert s.load_range("oi", "2024-01-01", "2024-01-01").first()["v"] == ids[max(ids)]
