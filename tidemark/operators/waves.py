"""Waves of a task graph: what can run at once, then what needed only that, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.sources import shared


def waves(tasks: DataFrame, needs: DataFrame, graph: list[str], task: str = "task", need: str = "need") -> DataFrame:
    """``graph``, task, wave and status of each task.

    A task's wave is one more than the greatest of those it needs, 0 if it needs none.  Tasks on a
    cycle, those that need a task which is not there, and all that need any of these have no wave
    and the status ``error``.  A need of a task for itself is a cycle; repeated rows count once.

    Peeled by the number of needs that are open: each wave joins the frontier alone with the
    edges and is written, so a plan does not grow with the depth of the graph and work ends when
    no task has become free.
    """
    key = [*graph, task]
    nodes = tasks.select(*key).distinct()
    edges = shared.stored(needs.select(*key, need).distinct().join(nodes, key, "left_semi"))
    open_needs = edges.groupBy(*key).agg(F.count("*").alias("_open"))
    left = shared.stored(nodes.join(open_needs, key, "left").select(*key, F.coalesce("_open", F.lit(0)).alias("_open")))
    spark, path, wave = tasks.sparkSession, shared.folder(tasks.sparkSession), 0
    schema = left.drop("_open").schema
    while True:
        free = f"{path}/wave={wave}"
        left.filter("_open = 0").drop("_open").write.parquet(free)
        frontier = spark.read.schema(schema).parquet(free)
        if frontier.isEmpty():
            break
        met = edges.join(frontier.withColumnRenamed(task, need), [*graph, need]).groupBy(*key).agg(F.count("*").alias("_met"))
        left = shared.stored(left.filter("_open > 0").join(met, key, "left").select(*key, (F.col("_open") - F.coalesce("_met", F.lit(0))).alias("_open")))
        wave += 1
    done = spark.read.schema(StructType([*schema.fields, StructField("wave", IntegerType())])).parquet(path)
    stuck = left.filter("_open > 0").select(*key, F.lit(None).cast("int").alias("wave"), F.lit("error").alias("status"))
    return done.select(*key, "wave", F.lit("ok").alias("status")).union(stuck)
