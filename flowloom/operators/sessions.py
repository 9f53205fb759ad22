"""Sessions: activity of a key split where it falls silent for longer than a gap.

Every event opens an interval from its start to its end plus the gap; intervals of a key that
overlap or touch merge into one session.  What has to be kept of a session to merge it with others
is its interval and its number of events: that is the state here, a table (keys,
session_start, session_end, events), and merging states is merging events once more.

``sessionize`` merges all events at hand.  ``advance`` merges the events of one delivery into the
state left by earlier ones and closes what a watermark has passed, so that late
events still extend or bridge open sessions; ``flowloom.streaming`` has the same as a stream.
All of it is arithmetic of bigints, so starts may lie anywhere in them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.sources.tables import floor_div

DEFAULT_SHARD_MS = 3_600_000


def saturating_end(start: Column, duration: Column) -> Column:
    """start + duration, where a null or negative duration is 0 and a sum past bigint is its largest value."""
    length = F.greatest(F.coalesce(duration, F.lit(0)).cast("long"), F.lit(0).cast("long"))
    return F.coalesce(F.try_add(start, length), F.lit(2**63 - 1))


def _merged(intervals: DataFrame, by: Sequence[str], gap_ms: int) -> DataFrame:
    """by, s, e, n: the intervals (by, s, e, n) of each group whose distance is at most the gap, as one."""
    ordered = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    seen = intervals.withColumn("reach", reach)
    # a difference that overflows is longer than any gap
    far = (F.col("s") > F.col("reach")) & F.coalesce(F.try_subtract("s", "reach") > gap_ms, F.lit(True))
    opens = F.when(F.col("reach").isNull() | far, 1).otherwise(0)
    numbered = seen.withColumn("no", F.sum(opens).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "no").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n")).drop("no")


def _by_shard(events: DataFrame, keys: Sequence[str], start: str, duration: str, gap_ms: int, identity: Sequence[str], shard_ms: int) -> tuple[DataFrame, list[str]]:
    """k0.., s, e, n: the sessions within each shard of time, by their starts."""
    k = [f"k{i}" for i in range(len(keys))]
    ids = [f"i{i}" for i in range(len(identity))]
    rows = events.select(
        *[F.col(x).alias(a) for x, a in zip(keys, k)],
        *[F.col(x).alias(a) for x, a in zip(identity, ids)],
        F.col(start).cast("long").alias("s"),
        F.col(duration).cast("long").alias("d"),
    ).dropna(subset=[*k, "s"])
    rows = rows.select(*k, *ids, "s", saturating_end(F.col("s"), F.col("d")).alias("e"), floor_div(F.col("s"), shard_ms).alias("shard"))
    rows = rows.repartition(*k, "shard")
    if ids:
        rows = rows.distinct()  # the partitioning holds for it: no second shuffle
    return _merged(rows.select(*k, "shard", "s", "e", F.lit(1).cast("long").alias("n")), [*k, "shard"], gap_ms).select(*k, "s", "e", "n"), k


def _shown(found: DataFrame, keys: Sequence[str], k: Sequence[str]) -> DataFrame:
    return found.select(
        *[F.col(a).alias(x) for x, a in zip(keys, k)],
        F.col("s").alias("session_start"),
        F.col("e").alias("session_end"),
        F.coalesce(F.try_subtract("e", "s"), F.lit(2**63 - 1)).alias("session_duration"),
        F.col("n").alias("events"),
    )


def sessionize(
    events: DataFrame,
    keys: Sequence[str],
    start: str,
    duration: str,
    gap_ms: int,
    identity: Sequence[str] = (),
    shard_ms: int = DEFAULT_SHARD_MS,
) -> DataFrame:
    """keys, session_start, session_end, session_duration, events.

    Merging runs twice.  First the events of a key are spread over shards of time by their
    start and merge within their shard, so that a key with a third of all rows becomes as
    many tasks as it has shards; what leaves a shard is one row per session in it, of which
    there can be no more than shard length over gap.  Then those rows merge per key in the
    same way.  A session is exact however many shards it crosses, because a merged row keeps
    its whole extent and shards go by starts only.

    Rows without a start or with a null key are in no session.  A null or negative duration
    is 0, an end or a length past bigint its largest value.  Rows that agree in identity, key, start
    and duration are copies and count once; with no identity every row counts.  An empty table gives
    no rows.  Further columns of ``events`` are not looked at, so their names do not matter.
    """
    local, k = _by_shard(events, keys, start, duration, gap_ms, identity, shard_ms)
    return _shown(_merged(local, k, gap_ms), keys, k)


def advance(
    state: DataFrame | None,
    events: DataFrame,
    keys: Sequence[str],
    start: str,
    duration: str,
    gap_ms: int,
    closed_before: int | None,
    watermark: int | None,
    identity: Sequence[str] = (),
    shard_ms: int = DEFAULT_SHARD_MS,
) -> tuple[DataFrame, DataFrame]:
    """(closed, open) sessions once ``events`` have come on top of ``state``, the open sessions so far.

    ``closed_before`` is the watermark of the delivery before (null at the first): events that
    start no later are too late and left out, all others count however late they are.
    ``watermark`` is the one after this delivery; a session is closed once it is not before the
    session's end and the gap, as no event that still counts can touch that.  With a null watermark, the end of all
    input, everything is closed.  Over all deliveries, the closed sessions are those ``sessionize``
    finds in the events that were not too late.  Copies are told within one delivery only.

    Both results are read from the same merge: stage it, or the state, if both are used.
    """
    if closed_before is not None:
        events = events.where(F.col(start) > closed_before)
    found, k = _by_shard(events, keys, start, duration, gap_ms, identity, shard_ms)
    if state is not None:
        found = found.unionByName(
            state.select(*[F.col(x).alias(a) for x, a in zip(keys, k)], F.col("session_start").alias("s"), F.col("session_end").alias("e"), F.col("events").alias("n"))
        )
    whole = _shown(_merged(found, k, gap_ms), keys, k)
    if watermark is None:
        return whole, whole.where(F.lit(False))
    past = F.coalesce(F.try_add("session_end", F.lit(gap_ms)) <= watermark, F.lit(False))
    return whole.where(past), whole.where(~past)
