"""Operators over unbounded flow records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.sessions import saturating_end

#: Times of the years 1 to 9999; clocks outside them are wrong, and one of them would carry the watermark past all that is still to come.
EARLIEST_MS, LATEST_MS = -62_135_596_800_000, 253_402_300_799_999


def in_calendar(start: Column) -> Column:
    """True where a start can be a time; false where it cannot or is null.  The streams take the former, ``where(~in_calendar(...))`` are the rejects."""
    return F.coalesce(start.between(EARLIEST_MS, LATEST_MS), F.lit(False))


def open_for(start: Column, end: Column, gap_ms: int) -> Column:
    """How long the session window of an event is: to its end, and the gap.

    Spark merges windows that overlap or touch, so a start exactly ``gap_ms`` after the latest
    end still belongs to the session.  A window must not be empty: with a gap of 0 it is
    a microsecond long, which no whole millisecond falls into.
    """
    ms = end - start + F.lit(gap_ms)
    hours = F.call_function("div", ms, F.lit(3_600_000).cast("long")).cast("int")
    seconds = ((ms % F.lit(3_600_000)).cast("decimal(18,6)") / F.lit(1000)).cast("decimal(18,6)")
    if gap_ms == 0:
        seconds = seconds + F.lit(0.000001).cast("decimal(18,6)")
    return F.make_interval(hours=hours, secs=seconds)


def stream_sessions(events: DataFrame, keys: Sequence[str], start: str, duration: str, gap_ms: int, lateness: str, identity: str | None = None) -> DataFrame:
    """The sessions of ``flowloom.operators.sessions``, each once it can no longer change.

    State per key is its open sessions.  An event opens the interval to its end plus the gap; it
    joins, extends or bridges the sessions it overlaps, however late it is within ``lateness``
    of the latest start seen.  A session comes out when the watermark passes its end.  With
    ``identity`` copies of an event within the lateness count once.  Events whose start is outside
    the calendar are rejects (see ``in_calendar``); an end beyond it is its last moment.
    """
    rows = events.where(in_calendar(F.col(start))).withColumn("_at", F.timestamp_millis(F.col(start))).withWatermark("_at", lateness)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    if identity:
        rows = rows.dropDuplicatesWithinWatermark([identity])
    rows = rows.withColumn("_end", saturating_end(F.col(start).cast("long"), F.col(duration).cast("long")))
    window = F.session_window("_at", open_for(F.col(start).cast("long"), F.least("_end", F.lit(LATEST_MS)), gap_ms)).alias("w")
    return (
        rows.groupBy(window, *keys)
        .agg(F.min(F.col(start).cast("long")).alias("session_start"), F.max("_end").alias("session_end"), F.count(F.lit(1)).alias("events"))
        .select(*keys, "session_start", "session_end", F.coalesce(F.try_subtract("session_end", "session_start"), F.lit(2**63 - 1)).alias("session_duration"), "events")
    )


def stream_totals(events: DataFrame, keys: Sequence[str], start: str, window: str, lateness: str, slide: str | None = None) -> DataFrame:
    """window_start and window_end (ms), keys, flows, packets, bytes per tumbling or sliding window, final once it is past.

    Events without a start or with one outside the calendar are in no window.
    """
    rows = events.where(in_calendar(F.col(start))).withColumn("_at", F.timestamp_millis(F.col(start))).withWatermark("_at", lateness)
    w = F.window("_at", window, slide) if slide else F.window("_at", window)
    sums = rows.groupBy(w.alias("w"), *keys).agg(*[F.sum(c).alias(c) for c in ("flows", "packets", "bytes")])
    return sums.select(F.unix_millis("w.start").alias("window_start"), F.unix_millis("w.end").alias("window_end"), *keys, "flows", "packets", "bytes")
