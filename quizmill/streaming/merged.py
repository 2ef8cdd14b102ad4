"""A table that streams and batches merge rows into by key: Parquet files by bucket, and a log of versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..operators.lifecycle import latest

LOG = "version long, stream string, batch long, bucket int, folder string"


class MergedTable:
    """The last row of each key (see lifecycle.latest), as of the batches that are in the log.

    Keys are dealt to a fixed number of buckets. A merge reads the buckets that its batch has keys of, writes them anew under a folder of its own, and then appends one file to the log,
    which lists the folders of all buckets. That file appears by one rename, so a merge is there whole or not at all, and readers keep the version they have begun with. A batch of
    a stream that is in the log already is left out when it comes again. The number of files that a read opens is bounded by the buckets, not by keys or merges.
    One writer at a time; folders that the log doesn't name any more (and those of merges that failed) are left for `unreferenced` to tell.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, at: str, tie: str, status: str | None = None, buckets: int = 16):
        self.spark, self.path, self.key, self.at, self.tie, self.status, self.buckets = spark, path.rstrip("/"), key, at, tie, status, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def log(self) -> DataFrame:
        """(version, stream, batch, bucket, folder): a row for each bucket of each version, with the folder that holds it; null for an empty bucket."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], LOG)
            raise

    def folders(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        """The version (the last one if not said), and the folder of each bucket that has rows: as many rows as there are buckets."""
        log = self.log()
        top = log.agg(F.max("version").alias("v")).first()["v"] if version is None else version
        if top is None:
            return -1, {}
        return top, {r["bucket"]: r["folder"] for r in log.where(F.col("version") == top).collect() if r["folder"]}

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(sorted(self.folders(version)[1].items()))

    def _rows(self, held: list[tuple[int, str]]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}/bucket_={bucket}" for bucket, folder in held])

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, batch: int, stream: str = "batch") -> bool:
        """Merges rows, unless this batch of the stream is in the log; whether it did. Rows without a key are left out."""
        log = self.log()
        if log.where((F.col("stream") == stream) & (F.col("batch") == batch)).limit(1).count():
            return False
        version, held = self.folders()
        fields = [f.name for f in self.schema]
        # the batch's own last rows first: a hot key is one row from here on. With a status, its first end is kept too.
        new = rows.select(*fields).where(F.col(self.key).isNotNull())
        new = self._reduced(new).select(*fields).persist()
        try:
            touched = sorted(r["b"] for r in new.select(self._bucket().alias("b")).distinct().collect())  # buckets at most
            old = self._rows([(b, held[b]) for b in touched if b in held])
            folder = f"data/{version + 1:012d}-{uuid.uuid4().hex}"
            both = self._joined(old, new).select(*fields, self._bucket().alias("bucket_"))
            if touched:
                both.repartition(len(touched), "bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/{folder}")
        finally:
            new.unpersist()
        now = held | dict.fromkeys(touched, folder)
        entries = [(version + 1, stream, batch, b, now.get(b)) for b in range(self.buckets)]
        self.spark.createDataFrame(entries, LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")
        return True

    def _reduced(self, rows: DataFrame) -> DataFrame:
        return latest(rows, self.key, self.at, self.tie, self.status)

    def _joined(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return self._reduced(old.unionByName(new))

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: a stream that starts again from its checkpoint merges no batch twice."""
        return lambda rows, batch: self.merge(rows, batch, stream) and None

    def unreferenced(self, keep: int = 2) -> DataFrame:
        """(folder): those in the log that the last `keep` versions don't read, for the owner of the folder to delete."""
        log = self.log().where("folder is not null")
        top = self.folders()[0]
        last = log.where(F.col("version") > top - keep).select("folder").distinct()
        return log.select("folder").distinct().join(last, "folder", "left_anti")


class ReplacedTable(MergedTable):
    """The rows of each key as its last batch gave them: a key that a batch has rows of loses all it had before. Same files, log and guarantees.

    For exports and question lists of many tests, as (key, rows...): the files are the buckets, whatever the number of tests.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, buckets: int = 16):
        super().__init__(spark, path, schema, key, key, key, None, buckets)

    def _reduced(self, rows: DataFrame) -> DataFrame:
        return rows

    def _joined(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select(self.key).distinct(), self.key, "left_anti").unionByName(new)
