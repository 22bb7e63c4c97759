"""A keyed table of Parquet files whose versions are committed whole.

Rows lie in ``buckets`` by the hash of their key.  A write replaces the files of the buckets it
touches; the others stay as they are.  A version is a list of each bucket's folder, written
aside and renamed into place: readers see the old version until then and the new one after, and a
writer that fails, or that another was faster than, leaves no trace in any version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed since this one read."""


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: list[str], buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._files.listStatus(at)] if self._files.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict[str, str]:
        """Bucket -> folder."""
        if not version:
            return {}
        stream = self._files.open(self._path(f"{self.path}/versions/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict[str, str]) -> None:
        aside, place = self._path(f"{self.path}/versions/{uuid.uuid4().hex}.new"), self._path(f"{self.path}/versions/{version:012d}.json")
        stream = self._files.create(aside)
        stream.write(json.dumps(manifest, sort_keys=True).encode())
        stream.close()
        if self._files.exists(place) or not self._files.rename(aside, place):
            self._files.delete(aside, False)
            raise Conflict(f"version {version} exists already")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _folders(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an earlier one."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        return self._folders(sorted(set(self._manifest(version).values())))

    def upsert(self, rows: DataFrame, order: list[str], update: bool = True) -> int:
        """Adds rows in one version and returns its number.

        Of several rows of a key, the last by ``order`` counts and replaces the one held; without
        ``update`` the first counts, and a row that is held stays.
        """
        version = (self.versions() or [0])[-1]
        manifest = self._manifest(version)
        fresh = rows.select(*self.schema.fieldNames()).withColumn("_bucket", self._bucket())
        # At most one number a bucket.
        touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())
        old = self._folders(sorted(manifest[str(b)] for b in touched if str(b) in manifest)).withColumn("_bucket", self._bucket())
        both = fresh.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
        first = [F.desc("_new"), *(F.desc(c) for c in order)] if update else [F.asc("_new"), *(F.asc(c) for c in order)]
        best = both.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket", *self.key).orderBy(*first))).filter("_place = 1")
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        best.select("_bucket", *self.schema.fieldNames()).write.partitionBy("_bucket").parquet(folder)
        self._commit(version + 1, manifest | {str(b): f"{folder}/_bucket={b}" for b in touched})
        return version + 1
