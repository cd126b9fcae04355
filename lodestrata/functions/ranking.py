"""Row numbers over orders that one task can't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.tables import cut

_ROW = (1 << 33) - 1


def numbered(df: DataFrame, name: str, order: list, groups: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``, the 1-based place in ``order`` (columns that leave no ties) within each group.

    Rows are dealt by ranges of (groups, order), so neither a large group nor one without any is a single task's; a
    row's place in its part, less that of the first of its group there, plus the group's rows in parts before. Only
    a row for each part and group is counted on.
    """
    keys = [F.col(g) for g in groups]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
    # written once: what is counted and what is numbered are the same rows
    placed = cut(placed)
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(_ROW))
    held = placed.groupBy(part.alias("__part"), *groups).agg(F.min(row).alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*(groups or (F.lit(0),))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    held = held.select("__part", "__first", "__before", *(F.col(g).alias(f"__{g}") for g in groups))
    same = part == F.col("__part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    at = (row - F.col("__first") + F.col("__before") + 1).cast("long")
    return placed.join(held, same).select(*df.columns, at.alias(name))


def running(df: DataFrame, name: str, value: str, order: list, groups: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``, the sum of the column ``value`` over the rows of its group up to it in ``order`` (columns that leave no ties).

    Sums have two levels: within ranges of (groups, order), as ``numbered`` deals them, and over the totals of a group's
    ranges before, of which there is a row each. A null counts as 0.
    """
    keys = [F.col(g) for g in groups]
    placed = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    own = Window.partitionBy("__part", *groups).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("__part", part).withColumn("__sum", F.sum(F.coalesce(F.col(value), F.lit(0))).over(own))
    held = placed.groupBy(part.alias("__part"), *groups).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__total"))
    earlier = Window.partitionBy(*(groups or (F.lit(0),))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"), *(F.col(g).alias(f"__{g}") for g in groups))
    same = F.col("__part") == F.col("__p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return summed.join(held, same).select(*df.columns, (F.col("__sum") + F.col("__before")).alias(name))
