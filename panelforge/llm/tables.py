"""Reading the driver's tables, and the few column helpers that several operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The whole text; a null text counts as the empty one."""
    return F.coalesce(F.col(col), F.lit(""))


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, also where lambdas inside `body` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, spark.checkpoint.dir.

    Where that is unset, tasks that are threads of the driver share one in the warehouse; on a cluster it
    must be set, since a folder of one machine isn't shared.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse") + "/checkpoints")
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of a loop, in the shared folder: each round's is written, then the one before is deleted.

    Parquet and not a checkpoint: that keeps what the optimizer knows of its columns, which
    multiplies from round to round. What a round reads must be the last table, or none of them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.last = spark, None

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{_shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if self.last is not None:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.last)
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def fresh(name: str, df: DataFrame) -> str:
    """A column name made of `name` that `df` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
