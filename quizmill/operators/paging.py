"""Pages of lists without sorting or skipping from the start: rows in order, in blocks, and an index of what each block holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block; a power of two.
BLOCK = 4096


class PageIndex:
    """The rows of each owner in order, under a path: `rows` are Parquet files sorted by block, `blocks` says how many of an owner's rows each block holds and how many come before it.

    A page reads the blocks that it lies in: a filter on the block prunes files and row groups by their statistics. Blocks are cut from rows that are dealt by ranges of owner and order, so an owner
    with a third of all rows has a third of all blocks, and no task sorts more than its range. The index has a row for each owner and block.
    """

    def __init__(self, spark: SparkSession, path: str, owner: str, order: list[str], descending: tuple[str, ...] = ()):
        self.spark, self.path, self.owner, self.names = spark, path.rstrip("/"), owner, order
        self.order: list[Column] = [F.col(c).desc() if c in descending else F.col(c).asc() for c in order]

    def build(self, rows: DataFrame, tasks: int | None = None, block: int = BLOCK) -> PageIndex:
        """Writes the rows and the index anew. The last column of the order must be unique for an owner, and none of it null; rows without an owner go."""
        if block & (block - 1):
            raise ValueError("block must be a power of two")
        by = [F.col(self.owner), *self.order]
        kept = rows.where(F.col(self.owner).isNotNull())
        dealt = kept.repartitionByRange(tasks, *by) if tasks else kept.repartitionByRange(*by)
        placed = dealt.sortWithinPartitions(*by).withColumn("block_", F.floor(F.monotonically_increasing_id() / block).cast("long"))
        placed.write.mode("overwrite").parquet(f"{self.path}/rows")
        # from what is written, as ranges are drawn from a sample
        held = self._rows().groupBy(self.owner, "block_").agg(F.count("*").alias("n"))
        before = Window.partitionBy(self.owner).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
        index = held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
        index.repartitionByRange(F.col(self.owner), F.col("block_")).sortWithinPartitions(self.owner, "block_").write.mode("overwrite").parquet(f"{self.path}/blocks")
        return self

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def blocks(self) -> DataFrame:
        """(owner, block_, n, before)."""
        return self.spark.read.parquet(f"{self.path}/blocks")

    def count(self, owner) -> int:
        """An owner's rows, from the index alone."""
        return self.blocks().where(F.col(self.owner) == F.lit(owner)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def page(self, owner, offset: int = 0, limit: int = 20) -> DataFrame:
        """limit rows (1 to 100) of an owner from an offset, in order, as operators.serving.page gives them."""
        size, skip = max(1, min(100, limit)), max(0, offset)
        mine = self.blocks().where((F.col(self.owner) == F.lit(owner)) & (F.col("before") < skip + size) & (F.col("before") + F.col("n") > skip))
        found = mine.orderBy("block_").collect()  # 1 + limit blocks at most, however small they are
        names = [r["block_"] for r in found]
        rows = self._rows().where((F.col(self.owner) == F.lit(owner)) & F.col("block_").isin(names)).drop("block_")
        return rows.orderBy(*self.order).offset(skip - found[0]["before"] if found else 0).limit(size)

    def pages(self, requests: DataFrame) -> DataFrame:
        """The rows of the pages that requests(owner, offset, limit) ask for, with `place`, their number in the owner's list from 1: many pages in one plan.

        Each request meets the index rows of its owner, then only rows of the blocks it lies in. Requests of an owner must differ in their offset or limit.
        """
        asked = requests.select(self.owner, F.greatest(F.lit(0), F.col("offset")).cast("long").alias("offset_"), F.greatest(F.lit(1), F.least(F.lit(100), F.col("limit"))).cast("long").alias("limit_"))
        lies = asked.join(self.blocks(), self.owner).where((F.col("before") < F.col("offset_") + F.col("limit_")) & (F.col("before") + F.col("n") > F.col("offset_")))
        met = self._rows().join(lies.drop("n"), [self.owner, "block_"])
        local = F.row_number().over(Window.partitionBy(self.owner, "block_", "offset_", "limit_").orderBy(*self.order))
        placed = met.withColumn("place", F.col("before") + local).where((F.col("place") > F.col("offset_")) & (F.col("place") <= F.col("offset_") + F.col("limit_")))
        return placed.drop("block_", "before", "offset_", "limit_")
