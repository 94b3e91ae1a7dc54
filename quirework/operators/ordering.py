"""Numbers and windows over ordered collections without a single task that sees all rows, or all rows of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.session import staged


def global_rank(df: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """df with a number from 1 in the order of `by` (which must tell all rows apart).

    Rows are sorted by range once and written; each keeps the number of its partition and its place there. The sizes of the partitions, one row each,
    give the offsets. Nothing but these sizes is gathered in one task."""
    placed = df.orderBy(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33) + 1)
    placed = staged(placed, "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


#: Rows of a key that one task's window holds.
BLOCK = 100_000


def group_rank(df: DataFrame, by: list[str], order: list[str], name: str = "k") -> DataFrame:
    """df with a number from 1 in each group of `by`, in the order of `order` (which must tell a group's rows apart). A group may be larger than any task: as in global_rank,
    rows are sorted by range once, and offsets come from one row for each partition and group."""
    placed = df.orderBy(*by, *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed, "ranked")
    per = placed.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_by_{c}") for c in by), (before - F.col("_first") + 1).alias("_offset"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return placed.join(offsets, same).withColumn(name, F.col("_at") + F.col("_offset")).select(*df.columns, name)


def trailing(ranked: DataFrame, by: list[str], rows: int, k: str = "k", block: int = BLOCK) -> tuple[DataFrame, WindowSpec]:
    """Rows of group_rank laid out in blocks, each led in by the last rows of the block before, and the window of a row and the rows - 1 before it; keep those where _own is true."""
    number = F.floor((F.col(k) - 1) / block)
    inside = (F.col(k) - 1) % block
    own = ranked.withColumns({"_block": number, "_own": F.lit(True)})
    lead = ranked.where(inside >= block - rows + 1).withColumns({"_block": number + 1, "_own": F.lit(False)})
    return own.unionByName(lead), W.partitionBy(*by, "_block").orderBy(k).rowsBetween(1 - rows, 0)


def running(ranked: DataFrame, by: list[str], of: dict[str, tuple[str, Column]], upto: int = 0, k: str = "k", block: int = BLOCK) -> DataFrame:
    """Rows of group_rank with running aggregates ('min', 'max' or 'sum' of an expression) over all rows of the group up to the own one (upto 0) or the one before (-1).

    Windows see one block of a group; what the blocks before it come to is one row each. Nulls don't count; null where there is none before."""
    funcs = {"min": F.min, "max": F.max, "sum": F.sum}
    x = ranked.withColumn("_block", F.floor((F.col(k) - 1) / block)).withColumns({f"_v_{n}": c for n, (_, c) in of.items()})
    per = x.groupBy(*by, "_block").agg(*(funcs[f](f"_v_{n}").alias(f"_b_{n}") for n, (f, _) in of.items()))
    earlier = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_block").alias("_bk"), *(funcs[f](f"_b_{n}").over(earlier).alias(f"_c_{n}") for n, (f, _) in of.items()))
    same = F.col("_block") == F.col("_bk")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    local = W.partitionBy(*by, "_block").orderBy(k).rowsBetween(W.unboundedPreceding, upto)
    x = x.join(per, same).withColumns({f"_l_{n}": funcs[f](f"_v_{n}").over(local) for n, (f, _) in of.items()})
    both = {"min": F.least, "max": F.greatest, "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)}
    return x.select(*ranked.columns, *(both[f](F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (f, _) in of.items()))
