"""Tables in the folder that the driver and all executors share, which loops write to cut their lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
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


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """Tables of a loop, in the shared folder: each round's is written, then the one before is deleted.

    Parquet and not a checkpoint: that keeps what the optimizer knows of its columns, which
    multiplies from round to round. What a round reads must be the last table, or none of them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.last = spark, None

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.clear()
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes the last table too, once nothing reads it any more."""
        if self.last is not None:
            delete(self.spark, self.last)
            self.last = None
