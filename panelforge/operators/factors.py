"""The sixteen base factors of a panel, as staged columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .panel import KEYS

CATEGORIES = {
    "MOM_1D": "Momentum", "MOM_7D": "Momentum", "MOM_30D": "Momentum", "MOM_90D": "Momentum",
    "FUNDING_RATE": "Funding", "FUNDING_RATE_ZS": "Funding", "TAKER_BUY_RATIO": "Taker Flow", "TAKER_NET_VOLUME": "Taker Flow",
    "OI_CHANGE": "Open Interest", "OI_USD": "Open Interest", "LS_RATIO": "Long/Short", "LS_RATIO_ZS": "Long/Short",
    "VOL_30D": "Volatility", "LOG_MCAP": "Size", "AMIHUD": "Liquidity", "SKEW_30D": "Skewness",
}
FACTORS = list(CATEGORIES)
YEAR = 365


def with_factors(panel: DataFrame, names: list[str] = FACTORS) -> DataFrame:
    """`panel` with the named factors.

    Three stages by ticker, which share one exchange and one sort, and one by date for the two
    z-scored factors. Lags are rows of the ticker. Momentum takes closes as they are; volatility,
    skewness and illiquidity take returns between last known closes.
    """
    unknown = set(names) - set(FACTORS)
    if unknown:
        raise KeyError(f"no such factors: {sorted(unknown)}")
    col, nz = F.col, lambda x: F.nullif(x, F.lit(0.0))
    close, oi = col("close"), col("oi_usd")
    ratio = col("taker_buy_ratio") if "taker_buy_ratio" in panel.columns else F.try_divide(col("taker_buy_volume"), col("taker_buy_volume") + col("taker_sell_volume"))
    first = {
        "MOM_1D": F.try_divide(close, C.lag(close, 1)) - 1,
        "MOM_7D": F.try_divide(close, C.lag(close, 7)) - 1,
        "MOM_30D": F.try_divide(close, C.lag(close, 30)) - 1,
        "MOM_90D": F.try_divide(C.lag(close, 7), C.lag(close, 97)) - 1,
        "FUNDING_RATE": C.lag(col("funding_rate"), 1),
        "TAKER_BUY_RATIO": C.lag(ratio, 1),
        "TAKER_NET_VOLUME": C.lag(col("taker_net_volume"), 1),
        "OI_CHANGE": F.try_divide(C.lag(oi, 1) - C.lag(oi, 2), C.lag(oi, 2)),
        "OI_USD": C.lag(F.ln(nz(oi)), 1),
        "LS_RATIO": C.lag(col("ls_ratio"), 1),
        "LOG_MCAP": F.ln(nz(col("market_cap"))),
    }
    returns, z = {"VOL_30D", "AMIHUD", "SKEW_30D"} & set(names), {"FUNDING_RATE_ZS", "LS_RATIO_ZS"} & set(names)
    lagged = {f"_{x}": first[x.removesuffix("_ZS")] for x in z}
    out = panel.withColumns({k: v for k, v in first.items() if k in names} | lagged | ({"_pad": C.padded(close)} if returns else {}))
    second = {f"__{x}": F.try_divide(col(f"_{x}") - C.ts_mean(col(f"_{x}"), 30, 20), nz(C.ts_std(col(f"_{x}"), 30, 20))) for x in z}
    if returns:
        second["_ret"] = F.try_divide(col("_pad"), C.lag(col("_pad"), 1)) - 1
    out = out.withColumns(second) if second else out
    third = {}
    if "VOL_30D" in names:
        third["VOL_30D"] = C.ts_std(col("_ret"), 30, 20) * F.sqrt(F.lit(float(YEAR)))
    if "SKEW_30D" in names:
        third["SKEW_30D"] = C.ts_skew(col("_ret"), 30, 20)
    if "AMIHUD" in names:
        third["AMIHUD"] = C.lag(F.try_divide(F.abs(col("_ret")), nz(close * col("volume"))), 1)
    third |= {x: C.cs_zscore(col(f"__{x}")) for x in z}
    out = out.withColumns(third) if third else out
    return out.select(*panel.columns, *names)


def factor(panel: DataFrame, name: str) -> DataFrame:
    """keys and `name`, of one factor."""
    return with_factors(panel, [name]).select(*KEYS, name)


def canonical(panel: DataFrame, column: str, name: str, *, category: str = "category", digits: int | None = None) -> DataFrame:
    """`panel` with `name`: the column clipped to its quantiles, standardised, without its category's mean, ranked; each by date.

    With `digits`, what lies between is rounded, so that ties don't depend on how sums are ordered.
    """
    settled = lambda x: x if digits is None else F.round(x, digits) + 0.0
    out = panel.withColumn("_c", settled(C.cs_winsor(F.col(column)))).withColumn("_c", settled(C.cs_zscore(F.col("_c"))))
    return out.withColumn("_c", settled(C.cs_neutralize(F.col("_c"), category))).withColumn(name, C.cs_rank(F.col("_c"))).drop("_c")


def neutralised(panel: DataFrame, column: str, dummies: list[str], name: str) -> DataFrame:
    """`panel` with `name`: the residuals of each date's least squares of a column on a constant and any dummies, overlapping ones too.

    Unknown values are left out, unknown dummies count as 0; a date with fewer than two known values
    has none. A date's sums of products are one aggregation, its few coefficients come from
    their pseudo-inverse, so that dummies that depend on each other do no harm.
    """
    y, x = F.col(column).cast("double"), [F.lit(1.0), *[F.coalesce(F.col(d).cast("double"), F.lit(0.0)) for d in dummies]]
    k = len(x)
    known = panel.where(y.isNotNull())
    sums = known.groupBy("date_utc").agg(
        F.count("*").alias("_n"), F.array(*[F.sum(x[i] * x[j]) for i in range(k) for j in range(k)]).alias("_xx"), F.array(*[F.sum(x[i] * y) for i in range(k)]).alias("_xy")
    )

    @F.pandas_udf("array<double>")
    def solved(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.pinv(np.reshape(a, (k, k)), hermitian=True) @ np.asarray(b) for a, b in zip(xx, xy, strict=True)])

    fitted = sums.where("_n >= 2").select("date_utc", solved("_xx", "_xy").alias("_b"))
    part = sum((F.get("_b", F.lit(i)) * x[i] for i in range(1, k)), F.get("_b", F.lit(0)) * x[0])
    return panel.join(fitted, "date_utc", "left").withColumn(name, y - part).select(*panel.columns, name)


def forward_return(panel: DataFrame, rows: int, name: str) -> DataFrame:
    """`panel` with the return over the next `rows` rows, between last known closes."""
    padded = panel.withColumn("_pad", C.padded(F.col("close")))
    return padded.withColumn(name, F.try_divide(F.lead("_pad", rows).over(C.ticker()), F.col("_pad")) - 1).drop("_pad")
