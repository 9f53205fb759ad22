"""The driver's queries of the general operators, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import balanced, coverage, sessions
from flowloom.sources.tables import distinct_flows, flow_records, present
from flowloom.staging import stage

SESSION_GAP_MS = 1_800_000
PAIR = ("srcip_hi", "srcip_lo", "dstip_hi", "dstip_lo")
MEASURES = ("bytes", "packets", "duration")


LATENESS_MS = 21_600_000


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    """All records as one delivery, after which the watermark is at the end of all input: however late a record came, it counts, and all sessions are closed."""
    rows = flow_records(spark, sf).where(present("srcip"))
    return sessions.advance(None, rows, PAIR[:2], "first", "duration", SESSION_GAP_MS, closed_before=None, watermark=None, identity=("flow_id",))[0]


def p1_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions from deliveries of a day each, a record counting if it is not over six hours later than the latest start before its delivery.

    Open sessions are carried from one delivery to the next as a table.
    """
    rows = flow_records(spark, sf).where(present("srcip") & F.col("first").isNotNull())
    day = F.call_function("div", F.min("received"), F.lit(86_400_000).cast("long"))
    rows = stage(rows.groupBy("flow_id", *PAIR[:2], "first", "duration").agg(day.alias("delivery")), "deliveries")
    marks = {r.delivery: r.latest - LATENESS_MS for r in rows.groupBy("delivery").agg(F.max("first").alias("latest")).collect()}  # one row a day
    state, before, out = None, None, []
    for delivery in sorted(marks):
        mark = marks[delivery] if before is None else max(before, marks[delivery])
        whole, _ = sessions.advance(state, rows.where(F.col("delivery") == delivery), PAIR[:2], "first", "duration", SESSION_GAP_MS, before, None)
        whole = stage(whole, "sessions")
        closed = F.col("session_end") + SESSION_GAP_MS <= mark
        out.append(whole.where(closed))
        state, before = whole.where(~closed), mark
    return reduce(DataFrame.unionByName, [*out, state]) if out else sessions.sessionize(rows, PAIR[:2], "first", "duration", SESSION_GAP_MS)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf).where("events >= 2").select("srcip_hi", "srcip_lo", "session_start", "session_end")


def p1_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = flow_records(spark, sf).where(present("srcip", "dstip"))
    return coverage.gaps(rows, PAIR, "first", "duration", longer_than_ms=60_000, at_most_ms=21_600_000)


def p3_periods(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.periods(flow_records(spark, sf).where(present("srcip", "dstip")), PAIR, "first", "duration")


def _by_key(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """Flow records with the address columns of absent addresses set to null, so they count in the whole only."""
    here = present(*fields)
    halves = [f"{x}_{h}" for x in fields for h in ("hi", "lo")]
    rows = distinct_flows(flow_records(spark, sf), *halves, *MEASURES)
    # read for totals, hot rows and the others: copies are removed once
    return stage(rows.select(*[F.when(here, F.col(x)).alias(x) for x in halves], *MEASURES), "bykey")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = balanced.hot_key_results(_by_key(spark, sf, "srcip", "dstip"), PAIR, MEASURES, hot_share=0.01)
    return found.select(*PAIR)


def p5_hot_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return balanced.hot_key_results(_by_key(spark, sf, "srcip", "dstip"), PAIR, MEASURES, hot_share=0.01)


def p5_per_srcip(spark: SparkSession, sf: str) -> DataFrame:
    return balanced.key_results(_by_key(spark, sf, "srcip"), PAIR[:2], MEASURES)


def p5_per_dstip(spark: SparkSession, sf: str) -> DataFrame:
    return balanced.key_results(_by_key(spark, sf, "dstip"), PAIR[2:], MEASURES)


def p5_per_pair(spark: SparkSession, sf: str) -> DataFrame:
    return balanced.key_results(_by_key(spark, sf, "srcip", "dstip"), PAIR, MEASURES)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_sessions, p1_deliveries, p3_found, p3_periods, p5_found, p5_hot_pairs, p5_per_srcip, p5_per_dstip, p5_per_pair)}


_HERE = "({x}_hi is not null and {x}_lo is not null and ({x}_hi <> 0 or {x}_lo <> 0))"
_SRC, _DST = _HERE.format(x="srcip"), _HERE.format(x="dstip")
_SESSIONS = f"""
with f as (select distinct flow_id, srcip_hi, srcip_lo, first as s, first + greatest(coalesce(duration, 0), 0) as e
           from flow_records where {_SRC} and first is not null),
r as (select *, max(e) over (partition by srcip_hi, srcip_lo order by s, e, flow_id rows between unbounded preceding and 1 preceding) as reach from f),
n as (select *, sum(case when reach is null or s - reach > {SESSION_GAP_MS} then 1 else 0 end)
             over (partition by srcip_hi, srcip_lo order by s, e, flow_id rows unbounded preceding) as no from r),
x as (select srcip_hi, srcip_lo, min(s) as session_start, max(e) as session_end, max(e) - min(s) as session_duration, cast(count(*) as bigint) as events
      from n group by srcip_hi, srcip_lo, no)
"""
_PAIR = ", ".join(PAIR)


def in_time(lateness_ms: int) -> str:
    """Rows of flow_records with a start and a srcip, but for those that start no later than the watermark left by the deliveries (days of arrival) before theirs."""
    return (
        f"(select t.* from (select *, received // 86400000 as delivery from flow_records where {_SRC} and first is not null) t join "
        f"(select delivery, max(max(first)) over (order by delivery rows between unbounded preceding and 1 preceding) - {lateness_ms} as mark from "
        f"(select received // 86400000 as delivery, first from flow_records where {_SRC} and first is not null) group by delivery) m using (delivery) where mark is null or first > mark)"
    )


_PERIODS = f"""
with f as (select distinct {_PAIR}, first as s, first + greatest(coalesce(duration, 0), 0) as e from flow_records where {_SRC} and {_DST} and first is not null),
r as (select *, max(e) over (partition by {_PAIR} order by s, e rows between unbounded preceding and 1 preceding) as reach from f),
n as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by {_PAIR} order by s, e rows unbounded preceding) as no from r)
"""


def _median_sql(keys: str, where: str, having: str = "true") -> str:
    med = lambda m: (
        f"(select {keys}, min({m}) as q_{m} from (select {keys}, {m}, row_number() over (partition by {keys} order by {m}) as rn, "
        f"count(*) over (partition by {keys}) as c from f where {m} is not null) where 2 * rn >= c group by {keys})"
    )
    joins = " ".join(f"left join {med(m)} using ({keys})" for m in MEASURES)
    sums = ", ".join(f"cast(sum({m}) as bigint) as sum_{m}" for m in MEASURES)
    return (
        f"with a as (select distinct flow_id, {_PAIR}, bytes, packets, duration from flow_records), f as (select * from a where {where}), "
        f"t as (select {keys}, cast(count(*) as bigint) as n, {sums} from f group by {keys}) "
        f"select {keys}, n, sum_bytes, sum_packets, sum_duration, q_bytes, q_packets, q_duration from t {joins} where {having}"
    )


def oracle_sql() -> dict[str, str]:
    share = "n * 100 >= (select count(*) from a)"
    return {
        "p1_found": _SESSIONS + "select srcip_hi, srcip_lo, session_start, session_end from x where events >= 2",
        "p1_sessions": _SESSIONS + "select * from x",
        "p1_deliveries": _SESSIONS.replace("from flow_records where", f"from {in_time(LATENESS_MS)} where") + "select * from x",
        "p3_found": _PERIODS + f"select {_PAIR}, reach as gap_start, s as gap_end from n where s - reach > 60000 and s - reach <= 21600000",
        "p3_periods": _PERIODS
        + f"select {_PAIR}, min(s) as period_start, max(e) as period_end, max(e) - min(s) as period_duration from n group by {_PAIR}, no",
        "p5_found": f"with a as (select distinct flow_id, {_PAIR} from flow_records) select {_PAIR} from a where {_SRC} and {_DST} "
        f"group by {_PAIR} having count(*) * 100 >= (select count(*) from a)",
        "p5_hot_pairs": _median_sql(_PAIR, f"{_SRC} and {_DST}", share),
        "p5_per_srcip": _median_sql("srcip_hi, srcip_lo", _SRC),
        "p5_per_dstip": _median_sql("dstip_hi, dstip_lo", _DST),
        "p5_per_pair": _median_sql(_PAIR, f"{_SRC} and {_DST}"),
    }
