"""`python -m panelforge`: the whole run over a panel, written to a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import Config
from .operators.panel import brand_panel, checked
from .plans.runner import run
from .sources.store import synthetic_panel


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="panelforge", description=__doc__)
    p.add_argument("--config", help="a YAML file; defaults hold for what it leaves out")
    p.add_argument("--output", required=True)
    p.add_argument("--seed", type=int)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--synthetic", action="store_true", help="a seeded random panel")
    source.add_argument("--panel", help="a Parquet table with the panel's columns")
    source.add_argument("--tables", help="a folder of base tables, of which the weekly panel is made")
    given = p.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    config = Config.from_yaml(given.config) if given.config else Config()
    if given.seed is not None:
        config.seed = given.seed
    if given.synthetic:
        panel = checked(synthetic_panel(spark, seed=config.seed, start=config.data.start))
    else:
        panel = checked(spark.read.parquet(given.panel)) if given.panel else brand_panel(spark, given.tables)
    run(panel, config, given.output)


if __name__ == "__main__":
    main()
