"""Tables of the driver's Parquet folders, and the topics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..config import TOPICS


#: Tables whose rows take long to work on; bytes a core below which their rows are dealt out first.
HEAVY, DEALT_BYTES = {"documents", "pages", "conversations"}, 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table. A small one of texts is often a single row group, that is one task: its rows go to all cores."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in HEAVY and int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * DEALT_BYTES:
        return rows.repartition(cores)
    return rows


def topics(spark: SparkSession) -> DataFrame:
    """(topic_id, slug, name, sort_order): six fixed rows, whose size Catalyst knows, so that joins broadcast them."""
    rows = ", ".join(f"({k + 1}L, '{slug}', '{name}', {k + 1})" for k, (slug, name) in enumerate(TOPICS))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(topic_id, slug, name, sort_order)")


def shared(spark) -> str:
    """The folder that the driver and all executors share; a temporary one only in local mode without that setting."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/") + "/quizmill"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return "file://" + tempfile.mkdtemp(prefix="quizmill-")


def kept(frame: DataFrame, name: str) -> DataFrame:
    """frame as a Parquet table in the shared folder, read again: for what is costly to make and read more than once."""
    path = f"{shared(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
