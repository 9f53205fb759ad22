"""Sums over all records a query processed, and over the headers of flow files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ("flows", "packets", "bytes")
CLASSES = {"tcp": 6, "udp": 17, "icmp": 1}
COUNTERS = [f"{m}{c}" for m in MEASURES for c in ("", "_tcp", "_udp", "_icmp", "_other")]


def processed(matching: DataFrame) -> DataFrame:
    """One row: flows, packets and bytes of all records given, whatever is shown of them."""
    return matching.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES])


def _rows_by_measure(one: DataFrame) -> DataFrame:
    """field, total, tcp, udp, icmp, other from one row of the fifteen counters."""
    parts = [F.struct(F.lit(m).alias("field"), *[F.col(f"{m}{c}").alias(c[1:] or "total") for c in ("", "_tcp", "_udp", "_icmp", "_other")]) for m in MEASURES]
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def metadata(headers: DataFrame) -> DataFrame:
    """Sums of the headers' counters by protocol class; no flow record is read.  An absent counter is 0."""
    return _rows_by_measure(headers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]))


def metadata_of_records(flows: DataFrame) -> DataFrame:
    """The same from the records themselves, where there are no headers."""
    return _rows_by_measure(counters(flows))


def counters(flows: DataFrame, *by: str) -> DataFrame:
    """The fifteen header counters of records, in all or per group."""
    proto = F.coalesce(F.col("proto"), F.lit(0))
    aggs = []
    for m in MEASURES:
        value = F.coalesce(F.col(m), F.lit(0)).cast("long")
        sums = {"": value} | {f"_{c}": F.when(proto == n, value).otherwise(0) for c, n in CLASSES.items()} | {"_other": F.when(proto.isin(*CLASSES.values()), 0).otherwise(value)}
        aggs += [F.coalesce(F.sum(x), F.lit(0)).alias(f"{m}{c}") for c, x in sums.items()]
    return flows.groupBy(*by).agg(*aggs) if by else flows.agg(*aggs)


def inconsistent(headers: DataFrame) -> DataFrame:
    """Headers with a total that its parts do not add up to: file_id, and the measures that differ."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    wrong = [F.when(zero(m) != sum((zero(f"{m}_{c}") for c in ("tcp", "udp", "icmp", "other")), F.lit(0)), m) for m in MEASURES]
    return headers.select("file_id", F.concat_ws(",", *wrong).alias("measures")).where("measures <> ''")
