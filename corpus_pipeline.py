"""The corpus pipeline: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.decontam import uncontaminated
from quizmill.llm.packing import pack
from quizmill.llm.pii import redact
from quizmill.llm.quality import accepted
from quizmill.llm.simhash import one_of_each_group
from quizmill.llm.stage import discard, released, table, tables_written, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, with all copies of theirs; the columns of documents stay.

    Null and empty texts are scored as empty ones, texts of any length whole; rows of equal text stay or go together. Without labels all have score 0.5 and stay. No rows: no rows.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five-word shingles, similarity 0.8 or more) stays, the one with the smallest id; null ids come last.

    Null, empty and wordless texts are one group; a text of fewer words than five is one shingle. Repeated rows are a group, texts of any length are read whole. No rows: no rows.
    """
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window (ten words of an item in a row, or all of a shorter one) go; words near each other alone don't count here.

    Null, empty and wordless texts stay. Repeated rows stay or go together; rows of an id but other texts are judged apart. No rows: no rows; no items: all stay.
    """
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts give way to the names of their kinds; n_chars follows. No row goes.

    Null texts stay null, and n_chars with them; empty ones stay empty. Repeated rows change alike, texts of any length are read whole. No rows: no rows.
    """
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token sequences of at most 1024: a row for each piece of a document (see llm.packing.pack).

    A null or empty text is one piece that holds its end mark; longer documents than 1024 tokens are cut, repeated rows packed as often as they are there. No rows: no rows.
    """
    return pack(docs, capacity=1024)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]

#: SQL has neither the classifier nor the sketches; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = tables_written()
        docs = written(stage(spark, docs, sf_dir), name)
        discard(spark, since, docs)  # what the stage wrote on its way
        released(spark)  # and its shuffle files
    return docs
