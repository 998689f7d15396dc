"""The first day for which a source has data, by few probes of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rounds


def first_days(symbols: DataFrame, probe: Callable[[DataFrame], DataFrame], start: str, end: str, *, step: int = 7) -> DataFrame:
    """symbol, first_day (NULL if there is none from `start` to `end`), probes: of each symbol of a table.

    `probe(spans)` gets symbol, first_day, last_day, one row for each symbol that is still searched for,
    and gives the symbols that have any data in their span. Spans grow from `step` days, each twice as
    long as the one before, until one has data; then halves of it are probed. Whether there is data
    from a fixed day up to another only ever turns to yes, so gaps later on don't mislead the search.
    For D days a symbol takes at most log2(D / step + 1) + log2(D) + 2 probes.

    All symbols advance together, one round a job; the state is a row for each, written in the
    shared folder each round. Repeated symbols count once, a null one is left out.
    """
    last = F.lit(end).cast("date")
    state = symbols.select("symbol").where(F.col("symbol").isNotNull()).distinct().select(
        "symbol", F.lit(start).cast("date").alias("low"), F.lit(None).cast("date").alias("high"), F.lit(step).alias("width"), F.lit(0).alias("probes")
    )
    rounds = Rounds(symbols.sparkSession)
    state = rounds.write(state)
    within, found = F.col("high").isNotNull(), F.col("_found").isNotNull()
    is_open = F.when(within, F.col("low") < F.col("high")).otherwise(F.col("low") <= last)
    half = F.date_add("low", (F.datediff("high", "low") / 2).cast("int"))
    until = F.when(within, half).otherwise(F.least(F.date_add("low", F.col("width") - 1), last))
    while not (todo := state.where(is_open)).isEmpty():
        spans = todo.select("symbol", F.col("low").alias("first_day"), until.alias("last_day"))
        has = probe(spans).select("symbol").distinct().withColumn("_found", F.lit(True))
        asked = state.join(has, "symbol", "left").withColumn("_to", F.when(is_open, until))
        state = rounds.write(
            asked.select(
                "symbol",
                F.when(F.col("_to").isNull() | found, F.col("low")).otherwise(F.date_add("_to", 1)).alias("low"),
                F.when(F.col("_to").isNotNull() & found, F.col("_to")).otherwise(F.col("high")).alias("high"),
                F.when(F.col("_to").isNull() | within, F.col("width")).otherwise(F.col("width") * 2).alias("width"),
                (F.col("probes") + F.col("_to").isNotNull().cast("int")).alias("probes"),
            )
        )
    return state.select("symbol", F.when(within, F.col("low")).alias("first_day"), "probes")
