"""Coverage of entities by intervals: merged periods, and the gaps between them.

Two levels.  Time is cut into shards of a fixed width.  An interval is clipped at the edge of
the shard it starts in; what sticks out, its overhang, begins at that edge, so the
overhangs of all intervals of one (entity, shard) cover what the longest of them covers, and
one number says how far.  Pieces inside a shard are merged there, so an entity with a third of
all intervals becomes many tasks; an interval never becomes more than its piece and its
share in that number, however long it is.

Then the coverage that touches or crosses edges is stitched: one row per (entity, shard), with
the end reached so far, gives every shard how far the earlier ones reach into it.  That
goes back to the pieces, which lie where they were: what starts beyond it begins a period,
after a gap.  No step sees more of an entity in one place than one row per shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.sessions import saturating_end
from flowloom.sources.tables import floor_div
from flowloom.staging import stage

DEFAULT_SHARD_MS = 2 * 3_600_000


def _starts(intervals: DataFrame, keys: Sequence[str], start: str, duration: str, shard_ms: int, whole: bool) -> tuple[DataFrame, list[str]]:
    """(k0.., shard, s, reach), the starts of all periods, and the names of k0..

    reach is the latest end before the start, null at an entity's first; with ``whole`` there
    is also a column of that name, the latest end of the entity.
    """
    k = [f"k{i}" for i in range(len(keys))]
    rows = intervals.select(
        *[F.col(x).alias(a) for x, a in zip(keys, k)], F.col(start).cast("long").alias("s"), F.col(duration).cast("long").alias("d")
    )
    # as conditions of their own, which reach the scan and which both readers below know of
    rows = rows.where(reduce(Column.__and__, [F.col(x).isNotNull() for x in (*k, "s")]))
    rows = rows.select(*k, floor_div(F.col("s"), shard_ms).alias("shard"), "s", saturating_end(F.col("s"), F.col("d")).alias("e"))
    # one shuffle, read twice: by the merge within shards and by the ends that shards reach; both
    # ask for the same columns (hence ``opening``, which filters nothing), else it could not be reused
    pieces = rows.repartition(*k, "shard")
    within = Window.partitionBy(*k, "shard").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    local = pieces.withColumn("reach", F.max("e").over(within)).where("reach is null or s > reach").select(*k, "shard", "s", "reach")
    ends = pieces.groupBy(*k, "shard").agg(F.max("e").alias("e"), F.min("s").alias("opening"))
    along = Window.partitionBy(*k).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    stitched = ends.select(*k, "shard", "opening", F.max("e").over(along).alias("earlier"), *([F.max("e").over(Window.partitionBy(*k)).alias("whole")] if whole else []))
    if not whole:
        stitched = stitched.where("earlier is not null")  # nothing reaches into an entity's first shard
    joined = local.join(stitched.hint("merge"), [*k, "shard"], "left").where("opening is null or s >= opening")
    # greatest takes no notice of nulls
    return joined.select(*k, "shard", "s", F.greatest("reach", "earlier").alias("reach"), *(["whole"] if whole else [])).where("reach is null or s > reach"), k


def gaps(
    intervals: DataFrame,
    keys: Sequence[str],
    start: str,
    duration: str,
    longer_than_ms: int = 0,
    at_most_ms: int | None = None,
    shard_ms: int = DEFAULT_SHARD_MS,
) -> DataFrame:
    """keys, gap_start, gap_end: the silences between consecutive periods of each entity.

    Intervals [start, start + duration] are closed: touching ones leave no gap.  Rows with a
    null key or start take no part, a null or negative duration is 0, ends past bigint are its
    largest value, repeated rows change nothing, an empty table has no gaps, further columns are not
    looked at.  Starts may lie anywhere in bigint.
    """
    starts, k = _starts(intervals, keys, start, duration, shard_ms, whole=False)

    def wanted(a: Column, b: Column) -> Column:
        length = F.try_subtract(b, a)  # null where it is longer than bigint can say
        keep = F.coalesce(length > longer_than_ms, F.lit(True))
        return keep & F.coalesce(length <= at_most_ms, F.lit(False)) if at_most_ms is not None else keep

    found = starts.where(F.col("reach").isNotNull() & wanted(F.col("reach"), F.col("s")))
    return found.select(*[F.col(a).alias(x) for x, a in zip(keys, k)], F.col("reach").alias("gap_start"), F.col("s").alias("gap_end"))


def periods(intervals: DataFrame, keys: Sequence[str], start: str, duration: str, shard_ms: int = DEFAULT_SHARD_MS) -> DataFrame:
    """keys, period_start, period_end, period_duration: overlapping, nested and touching intervals as one.

    A period ends where the next start's gap begins.  Within a shard the next start is at
    hand; only the last period of each shard is stitched to the first start of a later one.
    Null keys and starts, durations, repeats, empty tables and further columns: as for ``gaps``.
    """
    starts, k = _starts(intervals, keys, start, duration, shard_ms, whole=True)
    within = Window.partitionBy(*k, "shard").orderBy("s")
    seen = starts.select(*k, "shard", "s", "whole", F.lead("reach").over(within).alias("e"), F.first("reach").over(within).alias("before"))
    seen = stage(seen, "starts")  # read for the periods that are complete and for the others: merged once
    last = F.col("e").isNull()
    open_ones = seen.where(last).withColumn("e", F.coalesce(F.lead("before").over(Window.partitionBy(*k).orderBy("shard")), F.col("whole")))
    return seen.where(~last).select(*k, "s", "e").unionByName(open_ones.select(*k, "s", "e")).select(
        *[F.col(a).alias(x) for x, a in zip(keys, k)],
        F.col("s").alias("period_start"),
        F.col("e").alias("period_end"),
        F.coalesce(F.try_subtract("e", "s"), F.lit(2**63 - 1)).alias("period_duration"),
    )
