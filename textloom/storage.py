"""Tables in the folder that driver and executors share, by which plans cut their lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="textloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a folder of our own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return folder
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return _own_folder()
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer; input of many splits stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """Intermediate results as written tables in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark).rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path, schema = f"{self.root}/{label}", df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def numbered(self, df: DataFrame, order: list[Column], name: str) -> DataFrame:
        """df with ``name``, its rows' numbers from 0 on in this order.

        Rows are dealt by ranges of the order and numbered within them; what each range begins with is summed up over the ranges,
        a row for each. No task orders all rows, and ties in the first columns of the order are split by the others. df is written
        first, since dealing by ranges reads its input twice, to find the ranges and to deal.
        """
        df = self.save(df, f"{name}-input")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
        rows = self.save(rows, f"{name}-rows").withColumn("_p", F.shiftright("_m", 33))
        ranges = rows.groupBy("_p").agg(F.count("*").alias("_n"))
        before = ranges.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
        out = rows.join(F.broadcast(before), "_p")  # at most spark.sql.shuffle.partitions rows
        return out.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_m", "_before")
