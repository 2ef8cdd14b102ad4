"""Running values over the rows of a key in order, when a key may have more rows than a task can hold.

The rows of a key are cut into pieces by a column that follows the order. Each piece is scanned by itself; its total is handed on to the pieces after it, of which
there are few. So a key with a third of all rows is scanned by as many tasks as it has pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scanned(rows: DataFrame, keys: list[str], piece: str, order: list[str], value: Column, out: str, fold: Callable[[Column | str], Column] = F.sum, join: Callable[[Column, Column], Column] = Column.__add__) -> DataFrame:
    """rows with `out`, the fold of value over the rows of the same keys up to and with each, by piece and then by order.

    fold: an aggregate that is associative (sum, max); join: the same of two values. The order within a piece needs a last column without ties, or equal rows
    get values in any order. Keys must not be null. Two windows over pieces and one small one over their totals: nothing has all rows of a key.
    """
    held = rows.withColumn("value_", value)
    local = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*keys, piece).agg(fold("value_").alias("total_"))
    carries = totals.withColumn("carry_", fold("total_").over(before)).where("carry_ is not null").drop("total_")
    here = held.withColumn("here_", fold("value_").over(local)).join(carries, [*keys, piece], "left")
    both = F.when(F.col("carry_").isNull(), F.col("here_")).otherwise(join(F.col("here_"), F.col("carry_")))
    return here.withColumn(out, both).select(*rows.columns, out)
