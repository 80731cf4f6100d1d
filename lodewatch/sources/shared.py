"""The folder that driver and executors share, and tables put there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset, a temporary folder on one machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and outlive a lost executor, and go when the program ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        try:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended before the interpreter
            return


def in_order(df: DataFrame, scratch: Scratch, order: list[str], at: str = "_at") -> DataFrame:
    """The rows sorted by `order` (nulls first) over all partitions, with a long that ascends with it; stored, so the places stay.

    Ranges take in all columns of `order`, so one frequent value of the first is spread over many tasks. The long isn't gapless: its upper
    bits say the range and its lower 33 the place there.
    """
    return scratch.put(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
