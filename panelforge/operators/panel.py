"""The panel: one row for each (date_utc, ticker), and its adapters from the base tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["date_utc", "ticker"]
MEASURES = ["close", "volume", "market_cap", "funding_rate", "taker_buy_volume", "taker_sell_volume", "taker_buy_ratio", "taker_net_volume", "oi_usd", "ls_ratio"]
PANEL_SCHEMA = T.StructType(
    [T.StructField("date_utc", T.DateType()), T.StructField("ticker", T.StringType())]
    + [T.StructField(m, T.DoubleType()) for m in MEASURES]
    + [T.StructField("category", T.StringType())]
)


class EmptyPanelError(ValueError):
    pass


class LookaheadBiasError(ValueError):
    pass


class InvalidFormulaError(ValueError):
    pass


class BloatLimitExceeded(ValueError):
    pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalised(df: DataFrame) -> DataFrame:
    """NaN as NULL and -0.0 as 0.0 in all double columns."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) + 0.0 for c, k in kinds.items() if k == "double"})


def checked(panel: DataFrame) -> DataFrame:
    """The panel in the order and types of PANEL_SCHEMA, missing columns as NULL; keys are a must."""
    missing = [k for k in KEYS if k not in panel.columns]
    if missing:
        raise ValueError(f"a panel needs the columns {missing}")
    own = set(panel.columns)
    return normalised(panel.select(*[(F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in PANEL_SCHEMA]))


def _measures() -> dict[str, Column]:
    quantity, flag = F.col("l_quantity"), F.col("l_returnflag")
    of = lambda cond: F.sum(F.when(cond, quantity).otherwise(0.0))
    return {
        # the 1e-9 settles quotients that lie halfway between two roundings
        "close": F.round(F.sum("l_extendedprice") / F.sum(quantity) + 1e-9, 6),
        "volume": F.round(F.sum(quantity), 6),
        "market_cap": F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4),
        "funding_rate": F.round(F.avg("l_discount") - F.avg("l_tax"), 8) + 0.0,
        "taker_buy_volume": F.round(of(flag == "N"), 6),
        "taker_sell_volume": F.round(of(flag != "N"), 6),
        "oi_usd": F.round(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(0.0)), 4),
        "ls_ratio": F.round(F.try_divide(F.sum(F.when(flag == "R", quantity)), F.sum(F.when(flag == "A", quantity))), 8),
    }


def _with_ratios(df: DataFrame) -> DataFrame:
    buy, sell = F.col("taker_buy_volume"), F.col("taker_sell_volume")
    return df.withColumns({
        "taker_buy_ratio": F.round(F.try_divide(buy, buy + sell), 8),
        "taker_net_volume": F.round(F.try_divide(buy - sell, buy + sell), 8),
    })


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week by brand, from lineitem and part: 25 tickers, static categories."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    grouped = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date_utc"), F.col("p_brand").alias("ticker"))
        .agg(*[v.alias(k) for k, v in _measures().items()])
    )
    category = F.concat(F.lit("CAT"), F.pmod(F.substring("ticker", 7, 10).cast("int"), F.lit(5)).cast("string"))
    return checked(_with_ratios(grouped).withColumn("category", category))


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week by supplier, which has gaps."""
    lines = table(spark, sf_dir, "lineitem")
    grouped = lines.groupBy(
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("date_utc"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker")
    ).agg(*[v.alias(k) for k, v in _measures().items()])
    return checked(_with_ratios(grouped).withColumn("category", F.lit("Other")))
