"""The whole run: search on the in-sample part, then measures of each formula found."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import factors, ic, portfolio, validation
from ..operators.cleaning import clean_panel, split_at
from ..operators.panel import EmptyPanelError, LookaheadBiasError
from ..sources import store
from .batch import evaluate, long_form
from .formula import Node
from .search import Search


#: Horizons, in days, whose decay is in the report.
REPORTED = (1, 7, 30)


@dataclass
class Result:
    front: list[tuple[Node, ic.Fitness]]
    report: DataFrame  # a row of measures for each formula
    returns: DataFrame  # formula, date_utc, ret, turnover, net
    decay: DataFrame  # formula, horizon, ic, and mean, that of all formulas at the horizon


def prepared(panel: DataFrame, config: Config) -> DataFrame:
    """The panel between the configured days, of the largest tickers by their last known market value, cleaned."""
    d = config.data
    rows = panel.where(F.col("date_utc").between(F.lit(d.start).cast("date"), F.lit(d.end).cast("date")))
    sizes = rows.groupBy("ticker").agg(F.max_by("market_cap", F.when(F.col("market_cap").isNotNull(), F.col("date_utc"))).alias("_size"))
    top = sizes.orderBy(F.col("_size").desc_nulls_last(), "ticker").limit(d.universe_size).select("ticker")
    return clean_panel(rows.join(F.broadcast(top), "ticker", "left_semi"), funding_lag=d.funding_lag, max_gap=d.max_gap)


def labelled(panel: DataFrame, horizon: int) -> DataFrame:
    return factors.forward_return(factors.forward_return(panel, horizon, "fwd"), 1, "fwd_1")


def find(panel: DataFrame, config: Config) -> list[tuple[Node, ic.Fitness]]:
    """The Pareto front of formulas over the in-sample dates of a prepared panel.

    Factors come from all dates, as they only look back; labels from the in-sample rows alone.
    """
    if config.data.funding_lag and not ic.unlagged_first_rows(panel, "funding_rate").isEmpty():
        raise LookaheadBiasError("funding_rate isn't lagged")
    wide = factors.with_factors(panel)
    inside = labelled(split_at(wide, config.data.is_end)[0], config.backtest.horizon).persist()
    try:
        if inside.isEmpty():
            raise EmptyPanelError("no rows before the in-sample end")
        s = config.search
        return Search(
            inside, "fwd", population=s.population, generations=s.generations, mate=s.mate, change=s.mutate, seed=config.seed,
            most=s.max_nodes, names=s.names, return_dates=inside.select("date_utc").distinct(),
        ).run()
    finally:
        inside.unpersist()


def _window_gaps(spark, signals: DataFrame, config: Config, sharpes: dict[str, float]) -> dict[str, tuple[bool, float]]:
    """formula -> alert and mean gap over walk-forward windows of the out-of-sample dates.

    Each span of a window is a backtest of its own: its first date has no turnover. Windows of which
    a span has no rows don't count; without any, the whole sample is compared with itself.
    """
    b = config.backtest
    first, last = signals.where(F.col("date_utc") >= F.lit(config.data.is_end).cast("date")).agg(F.min("date_utc"), F.max("date_utc")).first()
    windows = []
    if isinstance(first, date):
        windows = validation.walk_forward_windows(first, last + timedelta(days=1), inside=b.is_days, outside=b.oos_days, step=b.step_days, embargo=b.horizon)
    by: dict[str, dict[int, dict[str, float]]] = {}
    if windows:
        of = ("formula", "window_id", "segment")
        spans = portfolio.with_weights(validation.walk_forward(spark, signals, windows), "x", b.fraction, by=of)
        daily = portfolio.net_returns(spans, "weight", "fwd_1", b.cost_bps, by=of)
        s = F.when(F.count("*") > 5, portfolio.sharpe(F.col("net"))).otherwise(0.0)
        for r in daily.groupBy(*of).agg(s.alias("s")).collect():
            by.setdefault(r["formula"], {}).setdefault(r["window_id"], {})[r["segment"]] = r["s"]
    out = {}
    for name, sharpe in sharpes.items():
        pairs = [(w["is"], w["oos"]) for w in by.get(name, {}).values() if len(w) == 2] or [(sharpe, sharpe)]
        gaps = [validation.gap_alert(i, o, b.gap_threshold) for i, o in pairs]
        out[name] = any(alert for alert, _ in gaps), sum(g for _, g in gaps) / len(gaps)
    return out


def measure(panel: DataFrame, front: list[tuple[Node, ic.Fitness]], config: Config) -> Result:
    """Backtest and validation of formulas over all dates of a prepared panel.

    One long-form plan for all formulas; a row of measures of each comes to the driver.
    """
    b, spark = config.backtest, panel.sparkSession
    trees = {f"f{k}": t for k, (t, _) in enumerate(front)}
    schema = "formula string, rank_ic double, stability double, diversity double, sharpe double, max_drawdown double, turnover double"
    schema += "".join(f", ic_{h}d double" for h in REPORTED) + ", ic_ci_lower double, ic_ci_upper double, dsr_pvalue double, is_oos_gap double, gap_alert boolean"
    curve = "formula string, horizon int, ic double, mean double"
    if not trees:
        return Result(front, *[spark.createDataFrame([], x) for x in (schema, "formula string, date_utc date, ret double, turnover double, net double", curve)])
    wide = labelled(factors.with_factors(panel), b.horizon)
    signals = long_form(evaluate(wide, trees), list(trees), ["date_utc", "ticker", "fwd", "fwd_1"]).persist()
    of = ("formula",)
    daily = portfolio.net_returns(portfolio.with_weights(signals, "x", b.fraction, by=of), "weight", "fwd_1", b.cost_bps, by=of).persist()
    try:
        # what comes to the driver is a row for each formula, and for each with each horizon or window
        risk = daily.groupBy("formula").agg(portfolio.sharpe(F.col("net")).alias("sharpe"), F.avg("turnover").alias("turnover"))
        risk = {r["formula"]: r for r in risk.join(portfolio.max_drawdown(daily, "net", of), "formula").collect()}
        trials = config.search.population * config.search.generations + len(front)
        dsr = {r["formula"]: r["dsr"] for r in validation.deflated_sharpe_of(daily, trials, "net", of).collect()}
        interval = {r["formula"]: r for r in validation.bootstrap_ci(ic.daily_ic(signals, "fwd", joint=True), replicates=b.replicates).collect()}
        decay = {(r["formula"], r["horizon"]): r["ic"] for r in ic.ic_decay(signals, "fwd", sorted({*b.decay_horizons, *REPORTED})).collect()}
        gaps = _window_gaps(spark, signals, config, {n: risk[n]["sharpe"] for n in trees})
    finally:
        signals.unpersist()
    rows = []
    for name, (tree, fitness) in zip(trees, front, strict=True):
        r, ci, (alert, gap) = risk[name], interval.get(name), gaps[name]
        rows.append((
            str(tree), fitness.rank_ic, fitness.stability, fitness.diversity, r["sharpe"], r["max_drawdown"], r["turnover"],
            *[decay.get((name, h), 0.0) for h in REPORTED], ci and ci["lower"], ci and ci["upper"], dsr[name], gap, alert,
        ))
    named = F.broadcast(spark.createDataFrame([(n, str(t)) for n, t in trees.items()], "_name string, formula string"))
    returns = daily.withColumnRenamed("formula", "_name").join(named, "_name").select("formula", "date_utc", "ret", "turnover", "net")
    curves = spark.createDataFrame([(str(trees[n]), h, v) for (n, h), v in decay.items() if h in b.decay_horizons], "formula string, horizon int, ic double")
    curves = curves.join(F.broadcast(curves.groupBy("horizon").agg(F.avg("ic").alias("mean"))), "horizon").select("formula", "horizon", "ic", "mean")
    return Result(front, spark.createDataFrame(rows, schema), returns, curves)


def run(panel: DataFrame, config: Config, output: str | None = None) -> Result:
    """Search and measures; with `output`, the front, the diagnostics and the full report are written there."""
    ready = prepared(panel, config).persist()
    try:
        result = measure(ready, find(ready, config), config)
    finally:
        ready.unpersist()
    if output is not None:
        meta = store.metadata(config.as_dict(), revision=store.revision(), seed=config.seed, generations=config.search.generations, population=config.search.population, cost_bps=config.backtest.cost_bps)
        store.write_front(panel.sparkSession, [(str(t), f.rank_ic, f.stability, f.diversity) for t, f in result.front], output, meta)
        store.write_diagnostics(result.report, output, meta)
    return result
