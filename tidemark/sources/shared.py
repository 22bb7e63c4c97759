"""Tables that queries write: below the shared folder of the session, each run in a place of its own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import log


def folder(spark: SparkSession) -> str:
    """A new place below the checkpoint folder; where none is set, below a temporary one, in local mode only."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = context.getCheckpointDir()
    return f"{found.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written below the shared folder and read again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """An append-only table of Parquet files whose keys are written once."""

    def __init__(self, spark: SparkSession, path: str, schema, key: list[str]):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self.exists() else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        """Adds the rows whose key is not there yet, each once."""
        log.new_rows(rows, self.read(), self.key).write.mode("append").parquet(self.path)


def resumed(spark: SparkSession, path: str, df: DataFrame, by: str) -> DataFrame:
    """``df`` written below ``path`` by ``by``; what an earlier run has written is kept and not made again."""
    store = Store(spark, path, df.schema, [by])
    left = df.join(store.read().select(by).distinct(), by, "left_anti") if store.exists() else df
    left.write.mode("append").partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
