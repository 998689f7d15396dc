"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Rounds


def _with_least(rows: DataFrame, on: str, least: DataFrame, total: int) -> DataFrame:
    """`rows` (a, b) with m, the least node that `least` (`on`, m) has for column `on`; null if none.

    Keys of more than a thousandth of the `total` rows, of which there are at most a thousand, are
    looked up by a broadcast, so that the rows of a hub aren't gathered in one task.
    """
    hot = [r[0] for r in rows.groupBy(on).count().where(F.col("count") > max(128, total // 1_000)).select(on).collect()]
    if not hot:
        return rows.join(least, on, "left")
    some = F.col(on).isin(hot)
    return rows.where(~some).join(least, on, "left").unionByName(rows.where(some).join(F.broadcast(least.where(some)), on, "left"))


def components(edges: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """node, component (its least node) for all nodes of `edges` (a, b: longs).

    Each round links every node's larger neighbours to its least one, then its smaller ones (Kiveris
    et al., "Connected components in MapReduce and beyond"); the number of edges never grows, rounds
    go with the logarithm of the size, and every round is written to the shared folder.
    The edges of a node with many neighbours are spread over all tasks. Loops, repeated edges and nulls
    are left out; raises RuntimeError if it doesn't converge within `max_rounds`.
    """
    rounds = Rounds(edges.sparkSession)
    edges = rounds.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sums = F.count("*"), F.bit_xor(F.xxhash64("a", "b"))
    state = edges.agg(*sums).first()
    for _ in range(max_rounds):
        least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = _with_least(edges, "b", least, state[0]).select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, "a", least, state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, edges = state, rounds.write(small.where("a <> b").distinct())
        state = edges.agg(*sums).first()
        if before == state:
            break
    else:
        raise RuntimeError("components did not converge")
    root = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(root)
