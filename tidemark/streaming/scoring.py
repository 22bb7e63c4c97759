"""Scoring of matured predictions as they arrive, each once, however often a batch is repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scorer:
    """Outcomes of predictions arriving in a folder of Parquet files.

    Micro-batch b reads the predictions that batch b - 1 left pending, adds its own, and writes
    the ripe ones below ``outcomes/batch=b`` and the others below ``pending/batch=b``.  Both are
    overwritten when a batch is repeated, which therefore changes nothing.  ``ledger/batch=b`` is
    written last: only batches listed there are read.
    """

    def __init__(self, spark: SparkSession, path: str, schema, key: str, score: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.key, self.score = spark, path, schema, key, score

    def _done(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(path)) if files.exists(path) else []

    def _batches(self, name: str, batches: list[int]) -> DataFrame | None:
        return self.spark.read.parquet(*(f"{self.path}/{name}/batch={b}" for b in batches)) if batches else None

    def take(self, arrived: DataFrame, batch: int) -> None:
        """One micro-batch.  ``score`` adds ``realised``, null while the horizon is not over."""
        before = [b for b in self._done() if b < batch]
        waiting, told = self._batches("pending", before[-1:]), self._batches("outcomes", before)
        rows = arrived.select(*self.schema.fieldNames())
        rows = (rows.unionByName(waiting) if waiting is not None else rows).dropDuplicates([self.key])
        if told is not None:
            rows = rows.join(told.select(self.key), self.key, "left_anti")
        scored = self.score(rows.select(*self.schema.fieldNames())).persist()
        try:
            scored.filter("realised is not null").write.mode("overwrite").parquet(f"{self.path}/outcomes/batch={batch}")
            scored.filter("realised is null").select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/pending/batch={batch}")
        finally:
            scored.unpersist()
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")

    def drain(self, source: str) -> None:
        """Takes all files of ``source`` that no earlier call has taken."""
        stream = self.spark.readStream.schema(self.schema).parquet(source)
        stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start().awaitTermination()

    def outcomes(self) -> DataFrame:
        return self._batches("outcomes", self._done())

    def pending(self) -> DataFrame:
        return self._batches("pending", self._done()[-1:])
