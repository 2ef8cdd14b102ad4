"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

__all__ = ["discard", "released", "shared_dir", "sliced", "small_enough", "table", "tables_written", "unique_ids", "unwrapped", "whole", "with_broadcast_if", "written"]

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that setting is missing (tests, local mode)."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="quizmill-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return "file://" + _OWN[app]


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later stages restart from it, not from its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quizmill/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files and broadcasts of plans that have run and that nothing refers to any more.

    It learns of them when the driver collects garbage, which a driver with enough memory may not do for many stages.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_enough(df: DataFrame, limit_rows: int) -> bool:
    """Whether df has at most limit_rows rows; reads no more than it needs to tell."""
    return df.limit(limit_rows + 1).count() <= limit_rows


def with_broadcast_if(df: DataFrame, limit_rows: int) -> DataFrame:
    """df with a broadcast hint if a count shows at most limit_rows rows; otherwise df, to be joined by shuffle."""
    return F.broadcast(df) if small_enough(df, limit_rows) else df


def whole(df: DataFrame) -> Column:
    """All columns of df in a struct, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unwrapped(df: DataFrame, struct: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"{struct}.`{c}`").alias(c) for c in columns])


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether ids are never null and never repeat, so that they can stand for their rows."""
    counts = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    return counts.where("id is null or n > 1").limit(1).count() == 0


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what a worker makes of one at a time stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def discard(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes the tables written after the first `since`, but for the one that keep reads."""
    kept = set(keep.inputFiles()) if keep is not None else set()
    for at in range(len(_WRITTEN) - 1, since - 1, -1):
        owner, path = _WRITTEN[at]
        if owner is spark and not any(path.rpartition("/")[2] in f for f in kept):
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
            del _WRITTEN[at]


def tables_written() -> int:
    return len(_WRITTEN)


@atexit.register
def _clean() -> None:
    for spark in {id(s): s for s, _ in _WRITTEN}.values():
        try:
            discard(spark)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans it
            return
