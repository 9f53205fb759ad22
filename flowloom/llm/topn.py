"""The N best items of every group, ties always resolved the same way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(scored: DataFrame, group: Sequence[str], item: Sequence[str], score: str, n: int, more_than: int | None = None) -> DataFrame:
    """group, item, score and rank of the n items with the highest score per group.

    Items must be distinct within a group (aggregate first).  Ties go to the smaller item,
    compared column by column; a null score ranks last, a null item column first.  The rank
    filter over row_number lets the optimiser put a group limit below the shuffle, so a group
    with millions of items sends n rows per task, and another above it.

    ``more_than``: only groups with more than so many items, at least n.  One further rank
    is enough to tell, so the limit still holds; no group is counted.
    """
    depth = n if more_than is None else more_than + 1
    if depth < n:
        raise ValueError("more_than must be at least n - 1")
    order = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), *[F.col(x).asc_nulls_first() for x in item])
    ranked = scored.select(*group, *item, score, F.row_number().over(order).alias("rank")).where(F.col("rank") <= depth)
    if more_than is not None:
        deepest = Window.partitionBy(*group)
        ranked = ranked.withColumn("_deepest", F.max("rank").over(deepest)).where(F.col("_deepest") == depth).drop("_deepest")
    return ranked.where(F.col("rank") <= n)
