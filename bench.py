"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import random
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelforge import queries as Q
from panelforge.operators import factors, ic
from panelforge.operators.panel import brand_panel
from panelforge.plans.batch import evaluate
from panelforge.plans.formula import parse, random_tree

EXAMPLES = ["zscore(add(MOM_1D, MOM_7D))", "zscore(delta(ts_std(rank(add(MOM_30D, MOM_7D)), W_30), W_14))", "zscore(div(FUNDING_RATE, div(SKEW_30D, MOM_30D)))"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))  # for tasks
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, df_of, runs: int = 3) -> None:
        """The median of some runs, each into a sink that keeps nothing."""
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            df_of().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(sorted(took)[len(took) // 2], 4)

    timed("panel_build", lambda: brand_panel(spark, sf_dir))
    base = brand_panel(spark, sf_dir).repartition("ticker").persist()
    base.count()
    timed("factors_total", lambda: factors.with_factors(base))
    for name in ("MOM_7D", "VOL_30D", "SKEW_30D", "AMIHUD", "LS_RATIO_ZS"):
        timed(f"factor_{name.lower()}", lambda name=name: factors.factor(base, name))
    for name in ("g_rank", "g_zscore", "g_winsor", "g_ts_mean_30", "g_ts_std_30", "g_delta_30", "g_ts_rank_30"):
        timed(name, lambda name=name: evaluate(base, {"v": parse(Q.FORMULAS[name], Q._BASE)}))
    panel = factors.forward_return(factors.with_factors(base), 7, "r7").repartition("ticker").persist()
    panel.count()
    daily = lambda: ic.daily_ic(panel.select("date_utc", F.lit("f").alias("formula"), F.col("MOM_7D").alias("x"), "r7"), "r7")
    timed("rank_ic", daily)
    timed("stability", lambda: ic.newey_west(daily()))
    timed("diversity", lambda: ic.diversity(panel, ["MOM_7D"], [f for f in factors.FACTORS if f != "MOM_7D"]))
    timed("ic_decay", lambda: ic.ic_decay(panel.select("date_utc", "ticker", F.lit("f").alias("formula"), F.col("MOM_7D").alias("x"), "r7"), "r7", [1, 3, 7, 14, 30]))
    for k, text in enumerate(EXAMPLES, 1):
        timed(f"formula_{k}", lambda text=text: evaluate(panel, {"v": parse(text)}))
    rng = random.Random(1)
    for n in (1, 10, 50):
        trees = {f"f{k}": random_tree(rng, 2, 3) for k in range(n)}
        timed(f"batch_{n}_rank_ic", lambda trees=trees: ic.newey_west(ic.wide_ic(evaluate(panel, trees), list(trees), "r7")), runs=2)
    for name in ("r_net_returns", "r_deciles", "v_walk_forward", "v_permutation"):
        timed(name, lambda name=name: Q.QUERIES[name](spark, sf_dir), runs=2)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "formulas_per_second": round(50 / seconds["batch_50_rank_ic"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
