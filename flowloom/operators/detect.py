"""Detection of attacks in windows of time: what the filters and top lists of several queries find together, as one plan each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.plans.filterlang import compile_filter

SRC, DST = ["srcip_hi", "srcip_lo"], ["dstip_hi", "dstip_lo"]
WINDOW_SECONDS = 600


def window_number(seconds: Column, begin: int, end: int, size: int = WINDOW_SECONDS) -> Column:
    """Number of the window of a time in [begin, end): windows of ``size`` from begin, the last with all that is left over."""
    last = max((end - begin) // size, 1) - 1
    return F.least(F.call_function("div", seconds - begin, F.lit(size).cast("long")), F.lit(last).cast("long"))


def in_windows(flows: DataFrame, begin: int, end: int, size: int = WINDOW_SECONDS) -> DataFrame:
    """Flows that start in [begin, end), with the number of their window."""
    inside = flows.where((F.col("first") >= begin * 1000) & (F.col("first") < end * 1000))
    seconds = F.call_function("div", F.col("first"), F.lit(1000).cast("long"))
    return inside.withColumn("window", window_number(seconds, begin, end, size))


def top_per_window(flows: DataFrame, keys: list[str], score: str, n: int) -> DataFrame:
    """window, keys, flows, packets, bytes, first, last and rank of the n keys with the largest sums in each window; ties go to the smaller key."""
    sums = flows.groupBy("window", *keys).agg(*[F.sum(c).alias(c) for c in ("flows", "packets", "bytes")], F.min("first").alias("first"), F.max("last").alias("last"))
    order = Window.partitionBy("window").orderBy(F.col(score).desc_nulls_last(), *keys)
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


@dataclass(frozen=True)
class SynFlood:
    top: int = 10
    min_flows: int = 100_000
    packets_per_flow: float = 2
    ratio: float = 2


def syn_flood(flows: DataFrame, p: SynFlood = SynFlood()) -> DataFrame:
    """window, source, target, flows, packets, syn_packets, ack_packets of pairs that look like SYN floods.

    Of each window's top pairs by TCP flows, those with many flows of few packets, whose SYN
    packets outnumber ``ratio`` times their SYN+ACK packets.  ``flows`` comes from ``in_windows``.  Suspects are
    at most ``top`` per window; the optimiser chooses how to join them.
    """
    tcp = flows.where(compile_filter("proto TCP"))
    pair = [*SRC, *DST]
    suspects = top_per_window(tcp, pair, "flows", p.top).where((F.col("flows") >= p.min_flows) & (F.col("packets") < p.packets_per_flow * F.col("flows"))).select("window", *pair, "flows", "packets")
    packets = F.coalesce(F.col("packets"), F.lit(0))
    one = lambda text: F.sum(F.when(compile_filter(text), packets).otherwise(0))
    # in one pass over all pairs rather than one per suspect: sums combine before the shuffle
    counted = tcp.groupBy("window", *pair).agg(one("flags S and not flags AF").alias("syn_packets"), one("flags SA and not flags F").alias("ack_packets"))
    return suspects.join(counted, ["window", *pair]).where(F.col("syn_packets") > p.ratio * F.col("ack_packets"))


@dataclass(frozen=True)
class Amplification:
    port: int = 53
    min_bpp: int = 1200
    min_packets: int = 1
    max_packets: int = 1000
    top: int = 5
    bps: float = 1_000_000
    flows_per_second: float = 1000
    sample: int = 500
    changes: int = 10


def steady_sizes(flows: DataFrame, by: list[str], sample: int, changes: int) -> DataFrame:
    """by and steady: whether the first ``sample`` records of a group have fewer than ``changes`` changes of bytes from one to the next.

    Groups with fewer records are not steady.  Order is by first, then all else, so it is defined.
    """
    order = Window.partitionBy(*by).orderBy("first", "last", "bytes", "packets", "srcport", "dstport")
    some = flows.withColumn("no", F.row_number().over(order)).where(F.col("no") <= sample)
    changed = (F.col("bytes") != F.lag("bytes").over(Window.partitionBy(*by).orderBy("no"))).cast("int")
    counted = some.withColumn("changed", changed).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changes"))
    return counted.select(*by, ((F.col("n") == sample) & (F.col("changes") < changes)).alias("steady"))


def amplification(flows: DataFrame, p: Amplification = Amplification()) -> DataFrame:
    """window, target, bps and reliability (50 or 100) of targets of amplification attacks.

    Of each window's top targets of large answers from the port, those above a rate; of each
    one's top sources, the first and the last count 50 each if they send messages of steady size.
    """
    suspicious = flows.where(compile_filter(f"src port {p.port} and bpp > {p.min_bpp} and packets > {p.min_packets} and packets < {p.max_packets}"))
    top = top_per_window(suspicious, DST, "flows", p.top)
    ms = F.col("last") - F.col("first")
    bps = F.try_divide(F.col("bytes") * F.lit(8000.0), ms)
    victims = top.withColumn("bps", bps).where((F.col("bps") >= p.bps) | (F.col("flows") * 1000 / (ms + 0.2) >= p.flows_per_second)).select("window", *DST, "bps")
    sums = suspicious.join(victims, ["window", *DST], "left_semi").groupBy("window", *DST, *SRC).agg(F.sum("packets").alias("packets"))
    order = Window.partitionBy("window", *DST).orderBy(F.col("packets").desc_nulls_last(), *SRC)
    sources = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top)
    ends = sources.withColumn("lowest", F.max("rank").over(Window.partitionBy("window", *DST)))
    # a single source is both the first and the last of its list
    ends = ends.withColumn("share", (F.col("rank") == 1).cast("int") * 50 + (F.col("rank") == F.col("lowest")).cast("int") * 50).where("share > 0").select("window", *DST, *SRC, "share")
    pair = ["window", *DST, *SRC]
    messages = flows.where(compile_filter(f"port {p.port}")).join(ends.select(*pair), pair, "left_semi")
    steady = steady_sizes(messages, pair, p.sample, p.changes).where("steady")
    found = ends.join(steady.select(*pair), pair).groupBy("window", *DST).agg(F.sum("share").alias("reliability"))
    return victims.join(found, ["window", *DST])


def traffic_of(flows: DataFrame, pairs: DataFrame) -> DataFrame:
    """All records of the pairs found: the detail of a top list."""
    return flows.join(pairs.select(*SRC, *DST).distinct(), [*SRC, *DST], "left_semi")
