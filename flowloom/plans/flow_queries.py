"""The driver's queries of the query layer, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import convert, ip
from flowloom.operators import detect
from flowloom.plans import summary
from flowloom.plans.filterlang import compile_filter, parse
from flowloom.plans.query import FlowQuery
from flowloom.sources import timespec
from flowloom.sources.tables import flow_records, table

#: Filters of every construct, with their SQL over the zeroed records below; S and D are ranges of IPv4 addresses.
CORPUS = {
    "src ip 10.77.56.49": "S(172832817,172832817)",
    "not src ip 10.77.56.49": "not S(172832817,172832817)",
    "src net 10.0.0.0/8": "S(167772160,184549375)",
    "src ip 10.78.0.0/16": "S(172883968,172949503)",
    "ip 172.20.176.52": "S(2887036980,2887036980) or D(2887036980,2887036980)",
    "net 172.16.0.0/12": "S(2886729728,2887778303) or D(2886729728,2887778303)",
    "src and dst net 10.0.0.0/8": "S(167772160,184549375) and D(167772160,184549375)",
    "src or dst net 198.18.0.0/15": "S(3323068416,3323199487) or D(3323068416,3323199487)",
    "dst ip fd7b:992d:5ecf:36::e874": "dstip_hi = -181382939835170762 and dstip_lo = 59508",
    "src net fd04:a840::/32": "srcip_hi between -214861889169981440 and -214861884875014145",
    "src net fd04:a840:7077:3d::/96": "srcip_hi = -214861887488720835 and srcip_lo between 0 and 4294967295",
    "ip 10.77.56.49 and src port gt 1024": "(S(172832817,172832817) or D(172832817,172832817)) and srcport > 1024",
    "ip 10.77.56.49 or src port gt 1024 or dst port gt 1024": "S(172832817,172832817) or D(172832817,172832817) or srcport > 1024 or dstport > 1024",
    "ip 10.77.56.49 and not (src port gt 1024 and dst port gt 1024)": "(S(172832817,172832817) or D(172832817,172832817)) and not (srcport > 1024 and dstport > 1024)",
    "src net 10.0.0.0/8 or src port gt 1024 or dst port 80 or proto 17": "S(167772160,184549375) or srcport > 1024 or dstport = 80 or proto = 17",
    "net 10.0.0.0/8 and src port lt 1024 and dst port 80 and proto 6 and flags 4": "(S(167772160,184549375) or D(167772160,184549375)) and srcport < 1024 and dstport = 80 and proto = 6 and flags & 4 = 4",
    "packets gt 10 or packets lt 31 or bytes gt 1400 or bytes lt 5000 or flags 18 or duration lt 5": "packets > 10 or packets < 31 or bytes > 1400 or bytes < 5000 or flags & 18 = 18 or last - first < 5",
    "packets gt 10 and packets lt 31 and bytes gt 1400 and bytes lt 5000 and flags 18 and duration lt 5000": "packets > 10 and packets < 31 and bytes > 1400 and bytes < 5000 and flags & 18 = 18 and last - first < 5000",
    "net 10.0.0.0/8 and not (src port lt 1024 and dst port lt 1024) and proto 6 and flags 3 and bytes lt 25k": "(S(167772160,184549375) or D(167772160,184549375)) and not (srcport < 1024 and dstport < 1024) and proto = 6 and flags & 3 = 3 and bytes < 25000",
    "src or dst ip 192.168.20.0/24 or dst port 80 or flags 4 or bpp lt 400": "S(3232240640,3232240895) or D(3232240640,3232240895) or dstport = 80 or flags & 4 = 4 or coalesce(bytes // nullif(packets, 0) < 400, false)",
    "not bpp lt 400": "not coalesce(bytes // nullif(packets, 0) < 400, false)",
    "dst port in [80 443, 8080] and proto TCP": "dstport in (80, 443, 8080) and proto = 6",
    "not dst port in [80 443 0]": "dstport not in (80, 443, 0)",
    "port 53": "srcport = 53 or dstport = 53",
    "proto UDP and port >100": "proto = 17 and (srcport > 100 or dstport > 100)",
    "srcport 53 and proto UDP": "srcport = 53 and proto = 17",
    "proto TCP && (flags S && not flags AF)": "proto = 6 and flags & 2 = 2 and flags & 17 = 0",
    "proto TCP && (flags SA && not flags F)": "proto = 6 and flags & 18 = 18 and flags & 1 = 0",
    "src port 53 && bpp > 1200 && packets>1 && packets<1000": "srcport = 53 and coalesce(bytes // nullif(packets, 0) > 1200, false) and packets > 1 and packets < 1000",
    "proto in [ICMP 47 UDP] or bps > 1m": "proto in (1, 47, 17) or coalesce(bytes * 8000.0 / nullif(last - first, 0) > 1000000, false)",
    "inet6 and pps >= 2": "not (srcip_hi = 0 and srcip_lo between 0 and 4294967295) and coalesce(packets * 1000.0 / nullif(last - first, 0) >= 2, false)",
    "not (in if 3 or out if 4) and first >= 1709596800000": "input <> 3 and output <> 4 and first >= 1709596800000",
    "any": "true",
    "src ip != 10.77.56.49": "not S(172832817,172832817)",
    "dst net != 172.16.0.0/12 and proto != TCP": "not D(2886729728,2887778303) and proto <> 6",
    "not (dst ip != fd7b:992d:5ecf:36::e874)": "dstip_hi = -181382939835170762 and dstip_lo = 59508",
    "src ip in [10.77.56.49, fd04:a840::/32 172.16.0.0/12]": "S(172832817,172832817) or srcip_hi between -214861889169981440 and -214861884875014145 or S(2886729728,2887778303)",
    "not src and dst ip != 10.77.56.49": "S(172832817,172832817) or D(172832817,172832817)",
    "flags isset SA and flags isnset F": "flags & 18 = 18 and flags & 1 = 0",
    "not flags isset SA": "flags & 18 <> 18",
    "first >= 2024-03-06T12:30 and last < 2024-03-07": "first >= 1709728200000 and last < 1709769600000",
    "in if in [3 0] or port != 443": "input in (3, 0) or srcport <> 443 or dstport <> 443",
}


def _flows(spark: SparkSession, sf: str) -> DataFrame:
    return flow_records(spark, sf)


def _q(build) -> callable:
    return lambda spark, sf: build(FlowQuery()).run(_flows(spark, sf))


def filter_corpus_count(spark: SparkSession, sf: str) -> DataFrame:
    """Every filter of the corpus at once: what matches it, in one pass."""
    rows = _flows(spark, sf)
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    one = lambda cond, x: F.sum(F.when(cond, x).otherwise(F.lit(0)))
    aggs = [
        F.struct(F.lit(f).alias("filter"), one(compile_filter(f), F.lit(1)).alias("matching"), one(parse(f).column(False), F.lit(1)).alias("others"), one(compile_filter(f), value("packets")).alias("packets")).alias(f"f{i}")
        for i, f in enumerate(CORPUS)
    ]
    counted = rows.agg(*aggs)
    return counted.select(F.explode(F.array(*[F.col(f"f{i}") for i in range(len(CORPUS))])).alias("x")).select("x.*")


def processed_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary.processed(FlowQuery().where("proto TCP and dst port 443").matching(_flows(spark, sf)))


def metadata_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary.metadata(table(spark, sf, "flow_files"))


def metadata_of_records(spark: SparkSession, sf: str) -> DataFrame:
    return summary.metadata_of_records(_flows(spark, sf))


def metadata_inconsistent(spark: SparkSession, sf: str) -> DataFrame:
    return summary.inconsistent(table(spark, sf, "flow_files"))


def _in_files(spark: SparkSession, sf: str, begin: int, end: int) -> DataFrame:
    """Records of the files whose slot overlaps [begin, end): the selection by time works on files, not records."""
    files = table(spark, sf, "flow_files").where((F.col("slot") < end) & (F.col("slot") + F.col("slot_seconds") > begin))
    return _flows(spark, sf).join(files.select("file_id"), "file_id", "left_semi")


POINT, RANGE = "2024-03-06 10:02", "2024-03-05 12:00#2024-03-06 00:00"


def time_point(spark: SparkSession, sf: str) -> DataFrame:
    return FlowQuery().aggregate("proto").order_by("bytes").run(_in_files(spark, sf, *timespec.point(POINT)))


def time_range(spark: SparkSession, sf: str) -> DataFrame:
    return FlowQuery().statistic("srcip#flows").run(_in_files(spark, sf, *timespec.span(RANGE)))


def conversions(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversion that SQL has an equal for, per record."""
    return _flows(spark, sf).select(
        "flow_id",
        "file_id",
        convert.flags_text(F.col("flags")).alias("flags_text"),
        convert.protocol_text(F.col("proto")).alias("proto_text"),
        F.when(ip.is_v4(F.col("srcip_hi"), F.col("srcip_lo")), ip.v4_text(F.col("srcip_lo"))).alias("src_v4"),
        ip.words_text(F.coalesce("dstip_hi", F.lit(0)), F.coalesce("dstip_lo", F.lit(0))).alias("dst_words"),
        convert.duration_text(F.greatest(F.col("duration"), F.lit(0))).alias("duration_text"),
        convert.timestamp_text(F.col("first"), "UTC").alias("first_text"),
    )


def conv_volume(spark: SparkSession, sf: str) -> DataFrame:
    sums = FlowQuery().aggregate("proto").select("bytes,packets").run(_flows(spark, sf))
    return sums.select("proto", convert.volume_text(F.col("bytes")).alias("bytes"), convert.volume_text(F.col("packets"), "binary-prefix").alias("packets"))


def conv_address(spark: SparkSession, sf: str) -> DataFrame:
    found = FlowQuery().aggregate("dstip/16/48").run(_flows(spark, sf))
    return found.select(ip.text(F.col("dstip_hi"), F.col("dstip_lo")).alias("network"), "flows")


def semi_join_topn_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the ten pairs with most bytes: a top list fed into a second query."""
    rows = _flows(spark, sf)
    top = FlowQuery().where("proto TCP").statistic("srcip,dstip#bytes").run(rows)
    return detect.traffic_of(rows, top).select("flow_id", "file_id", "srcip_hi", "srcip_lo", "dstip_hi", "dstip_lo", "bytes")


BEGIN, END = 1709510400, 1710115200  # the week of the tables


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("first", "last", "bytes", "packets", "flows", "srcip_hi", "srcip_lo", "dstip_hi", "dstip_lo", "srcport", "dstport", "proto", "flags")]
    return detect.in_windows(_flows(spark, sf).select(*zero), BEGIN, END)


SYN, AMP = detect.SynFlood(), detect.Amplification()
#: No test table holds attacks of the size the operators look for; with these they find ordinary traffic, so that rows can be compared.
LOW_SYN = detect.SynFlood(min_flows=2, packets_per_flow=40, ratio=0.5)
LOW_AMP = detect.Amplification(port=0, min_bpp=50, bps=1, flows_per_second=0.0001, sample=2, changes=1)


def window_topn(spark: SparkSession, sf: str) -> DataFrame:
    return detect.top_per_window(_windows(spark, sf), detect.DST, "flows", 5)


def detect_syn_flood(spark: SparkSession, sf: str) -> DataFrame:
    return detect.syn_flood(_windows(spark, sf), SYN)


def detect_syn_flood_low(spark: SparkSession, sf: str) -> DataFrame:
    return detect.syn_flood(_windows(spark, sf), LOW_SYN)


def detect_amplification(spark: SparkSession, sf: str) -> DataFrame:
    return detect.amplification(_windows(spark, sf), AMP).select("window", *detect.DST, "reliability")


def detect_amplification_low(spark: SparkSession, sf: str) -> DataFrame:
    return detect.amplification(_windows(spark, sf), LOW_AMP).select("window", *detect.DST, "reliability")


def msg_size_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Every window's pairs with messages from or to the port, as detect_amplification looks at its suspects."""
    messages = _windows(spark, sf).where(compile_filter(f"port {AMP.port}"))
    return detect.steady_sizes(messages, ["window", *detect.SRC, *detect.DST], AMP.sample, AMP.changes)


def list_limit(spark: SparkSession, sf: str) -> DataFrame:
    """A limit without an order may give any matching records; that they match, and how many there are, is defined."""
    some = FlowQuery().where("port 443").limit(50).run(_flows(spark, sf))
    return some.agg(F.count(F.lit(1)).alias("shown"), F.count(F.when((F.col("srcport") != 443) & (F.col("dstport") != 443), 1)).alias("wrong"))


def limit_and_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What a limit leaves of an aggregation, and the sums over all matching records, which it does not touch."""
    query, rows = FlowQuery().where("proto UDP").aggregate("dstport").limit(7), _flows(spark, sf)
    return summary.processed(query.matching(rows)).withColumn("shown", query.run(rows).agg(F.count(F.lit(1))).scalar())


QUERIES = {
    "list_basic": _q(lambda q: q),
    "list_fields": _q(lambda q: q.select("srcip,duration,bps,pps,bpp,last,input,output")),
    "list_filter_port": _q(lambda q: q.where("port 23 or port 53")),
    "list_filter_limit": _q(lambda q: q.where("port 443").order_by("bytes").limit(50)),
    "sort_bytes_top": _q(lambda q: q.order_by("bytes").limit(5)),
    "sort_first_asc": _q(lambda q: q.order_by("first#asc").select("bytes").limit(100)),
    "sort_srcip": _q(lambda q: q.order_by("srcip#desc").select("dstip,bytes").limit(200)),
    "filter_not": _q(lambda q: q.where("not (proto TCP or dst port 53)").select("srcip,proto,dstport")),
    "filter_cidr": _q(lambda q: q.where("src net 10.0.0.0/8 and dst net 172.16.0.0/12").aggregate("srcip/16,dstip/16")),
    "filter_port_in": _q(lambda q: q.where("dst port in [80 443, 8443]").aggregate("dstport")),
    "filter_flags": _q(lambda q: q.where("proto TCP and flags S and not flags AF").aggregate("dstport")),
    "filter_bpp": _q(lambda q: q.where("bpp > 1200").aggregate("proto").select("flows,bytes")),
    "filter_corpus_count": filter_corpus_count,
    "aggr_srcip": _q(lambda q: q.aggregate("srcip").select("first,flows,packets,bytes")),
    "aggr_multi_key": _q(lambda q: q.aggregate("srcport,srcip,proto").select("flows,packets,bytes")),
    "aggr_filter_dstport": _q(lambda q: q.where("dst ip fd7b:992d:5ecf:36::e874").aggregate("dstport").select("flows,packets,bytes")),
    "aggr_prefix24": _q(lambda q: q.aggregate("srcip/24/64").select("flows,bytes,dstip")),
    "aggr_ts_align": _q(lambda q: q.aggregate("first/22").select("flows,bytes")),
    "aggr_duration_key": _q(lambda q: q.where("duration < 1000").aggregate("duration").select("flows")),
    "aggr_bytes_key": _q(lambda q: q.statistic("bytes").select("flows,bpp")),
    "aggr_default_fields": _q(lambda q: q.aggregate("dstport,proto")),
    "aggr_distinct_keys": _q(lambda q: q.aggregate("proto,flags").select("")),
    "stat_proto_flows": _q(lambda q: q.statistic("proto")),
    "stat_srcip_filter": _q(lambda q: q.where("proto UDP and port >100").statistic("srcip")),
    "stat_asc_top": _q(lambda q: q.statistic("dstport#packets#asc").limit(7)),
    "stat_pairs": _q(lambda q: q.statistic("srcip,dstip#bytes")),
    "processed_summary": processed_summary,
    "metadata_summary": metadata_summary,
    "metadata_of_records": metadata_of_records,
    "metadata_inconsistent": metadata_inconsistent,
    "time_point": time_point,
    "time_range": time_range,
    "conversions": conversions,
    "conv_volume": conv_volume,
    "conv_address": conv_address,
    "semi_join_topn_detail": semi_join_topn_detail,
    "window_topn": window_topn,
    "msg_size_stability": msg_size_stability,
    "detect_syn_flood": detect_syn_flood,
    "detect_amplification": detect_amplification,
    "detect_syn_flood_low": detect_syn_flood_low,
    "detect_amplification_low": detect_amplification_low,
    "list_limit": list_limit,
    "limit_and_summary": limit_and_summary,
}


def queries() -> dict:
    return dict(QUERIES)


_COLUMNS = ["first", "last", "bytes", "packets", "flows", "srcip_hi", "srcip_lo", "dstip_hi", "dstip_lo", "srcport", "dstport", "proto", "flags", "input", "output"]
_F = "with f as (select flow_id, file_id, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in _COLUMNS) + " from flow_records) "
_CALC = {
    "duration": "last - first",
    "bps": "bytes * 8000.0 / nullif(last - first, 0)",
    "pps": "packets * 1000.0 / nullif(last - first, 0)",
    "bpp": "cast(floor(bytes / nullif(packets, 0)) as double)",
}
_LIST = ["first", "packets", "bytes", "srcip_hi", "srcip_lo", "dstip_hi", "dstip_lo", "srcport", "dstport", "proto", "flags"]
_SUMS = "cast(sum(flows) as bigint) as flows, cast(sum(packets) as bigint) as packets, cast(sum(bytes) as bigint) as bytes"


def _where(text: str) -> str:
    side = {"S": "srcip", "D": "dstip"}
    return re.sub(r"\b([SD])\((\d+),(\d+)\)", lambda m: f"({side[m[1]]}_hi = 0 and {side[m[1]]}_lo between {m[2]} and {m[3]})", text)


def _list(where: str = "true", columns: list[str] = _LIST, tail: str = "") -> str:
    return _F + f"select {', '.join(columns)} from f where {_where(where)} {tail}"


def _grouped(keys: str, where: str = "true", what: str = _SUMS, tail: str = "") -> str:
    return _F + f"select {keys}, {what} from f where {_where(where)} group by all {tail}"


def _calcs(keys: str, where: str = "true", tail: str = "") -> str:
    inner = f"select {keys}, {_SUMS}, cast(bit_or(flags) as smallint) as flags, min(first) as first, max(last) as last from f where {_where(where)} group by all"
    names = [k.split(" as ")[-1].strip() for k in keys.split(", ")]
    shown = [*names, *(f"{_CALC[c]} as {c}" for c in ("duration", "bps", "pps", "bpp")), "flows", "packets", "bytes", "flags"]
    return _F + f"select {', '.join(shown)} from ({inner}) {tail}"


def _order(column: str, *rest: str, desc: bool = True) -> str:
    return f"order by {column} {'desc' if desc else 'asc'}, {', '.join(rest)}"


def oracle_sql() -> dict[str, str]:
    src, dst = ["srcip_hi", "srcip_lo"], ["dstip_hi", "dstip_lo"]
    pair = ", ".join(src + dst)
    unsigned = lambda c: f"xor({c}, cast(-9223372036854775808 as bigint))"
    out = {
        "list_basic": _list(),
        "list_fields": _list(columns=[*src, *(f"{v} as {k}" for k, v in _CALC.items()), "last", "input", "output"]),
        "list_filter_port": _list("srcport = 23 or dstport = 23 or srcport = 53 or dstport = 53"),
        "list_filter_limit": _list("srcport = 443 or dstport = 443", ["bytes", *[c for c in _LIST if c != "bytes"]], _order("bytes", *[c for c in _LIST if c != "bytes"]) + " limit 50"),
        "sort_bytes_top": _list("true", ["bytes", *[c for c in _LIST if c != "bytes"]], _order("bytes", *[c for c in _LIST if c != "bytes"]) + " limit 5"),
        "sort_first_asc": _list("true", ["first", "bytes"], "order by first, bytes limit 100"),
        "sort_srcip": _list("true", [*src, *dst, "bytes"], f"order by {unsigned('srcip_hi')} desc, {unsigned('srcip_lo')} desc, {pair}, bytes limit 200"),
        "filter_not": _list("not (proto = 6 or dstport = 53)", [*src, "proto", "dstport"]),
        "filter_cidr": _calcs("srcip_hi, srcip_lo & 4294901760 as srcip_lo, dstip_hi, dstip_lo & 4294901760 as dstip_lo", "S(167772160,184549375) and D(2886729728,2887778303)"),
        "filter_port_in": _calcs("dstport", "dstport in (80, 443, 8443)"),
        "filter_flags": _calcs("dstport", "proto = 6 and flags & 2 = 2 and flags & 17 = 0"),
        "filter_bpp": _grouped("proto", "bytes // nullif(packets, 0) > 1200", "cast(sum(flows) as bigint) as flows, cast(sum(bytes) as bigint) as bytes"),
        "filter_corpus_count": _F
        + " union all ".join(
            f"select '{f}' as filter, cast(count(*) filter ({_where(w)}) as bigint) as matching, cast(count(*) - count(*) filter ({_where(w)}) as bigint) as others, "
            f"cast(coalesce(sum(packets) filter ({_where(w)}), 0) as bigint) as packets from f"
            for f, w in CORPUS.items()
        ),
        "aggr_srcip": _grouped("srcip_hi, srcip_lo", what="min(first) as first, " + _SUMS),
        "aggr_multi_key": _grouped("srcport, srcip_hi, srcip_lo, proto"),
        "aggr_filter_dstport": _grouped("dstport", "dstip_hi = -181382939835170762 and dstip_lo = 59508"),
        "aggr_prefix24": _F
        + "select srcip_hi, case when srcip_hi = 0 and srcip_lo between 0 and 4294967295 then srcip_lo & 4294967040 else 0 end as srcip_lo, cast(sum(flows) as bigint) as flows, "
        f"cast(sum(bytes) as bigint) as bytes, arg_min(dstip_hi, ({unsigned('dstip_hi')}, {unsigned('dstip_lo')})) as dstip_hi, arg_min(dstip_lo, ({unsigned('dstip_hi')}, {unsigned('dstip_lo')})) as dstip_lo "
        "from f group by 1, 2",
        "aggr_ts_align": _F + "select first >> 22 << 22 as first, cast(sum(flows) as bigint) as flows, cast(sum(bytes) as bigint) as bytes from f group by 1",
        "aggr_duration_key": _F + "select last - first as duration, cast(sum(flows) as bigint) as flows from f where last - first < 1000 group by 1",
        "aggr_bytes_key": _F
        + "select bytes, flows, cast(floor(bytes / nullif(packets, 0)) as double) as bpp from (select bytes, cast(sum(flows) as bigint) as flows, sum(packets) as packets from f group by 1) "
        "order by flows desc, bytes, bpp limit 10",
        "aggr_default_fields": _calcs("dstport, proto"),
        "aggr_distinct_keys": _F + "select distinct proto, flags from f",
        "stat_proto_flows": _calcs("proto", tail="order by flows desc, proto limit 10"),
        "stat_srcip_filter": _calcs("srcip_hi, srcip_lo", "proto = 17 and (srcport > 100 or dstport > 100)", "order by flows desc, srcip_hi, srcip_lo limit 10"),
        "stat_asc_top": _calcs("dstport", tail="order by packets, dstport limit 7"),
        "stat_pairs": _calcs(pair, tail=f"order by bytes desc, {pair} limit 10"),
        "processed_summary": _F + f"select {_SUMS} from f where proto = 6 and dstport = 443",
        "metadata_summary": " union all ".join(
            f"select '{m}' as field, " + ", ".join(f"cast(sum(coalesce({m}{c}, 0)) as bigint) as {c[1:] or 'total'}" for c in ("", "_tcp", "_udp", "_icmp", "_other")) + " from flow_files"
            for m in summary.MEASURES
        ),
        "metadata_of_records": _F
        + " union all ".join(
            f"select '{m}' as field, cast(sum({m}) as bigint) as total, cast(sum({m}) filter (proto = 6) as bigint) as tcp, cast(sum({m}) filter (proto = 17) as bigint) as udp, "
            f"cast(sum({m}) filter (proto = 1) as bigint) as icmp, cast(sum({m}) filter (proto not in (1, 6, 17)) as bigint) as other from f"
            for m in summary.MEASURES
        ),
        "metadata_inconsistent": "select * from (select file_id, concat_ws(',', "
        + ", ".join(f"case when coalesce({m}, 0) <> " + " + ".join(f"coalesce({m}_{c}, 0)" for c in ("tcp", "udp", "icmp", "other")) + f" then '{m}' end" for m in summary.MEASURES)
        + ") as measures from flow_files) where measures <> ''",
        "time_point": _files(*timespec.point(POINT)) + _calcs("proto").removeprefix(_F),
        "time_range": _files(*timespec.span(RANGE)) + _calcs("srcip_hi, srcip_lo", tail="order by flows desc, srcip_hi, srcip_lo limit 10").removeprefix(_F),
        "conversions": _conversions(),
        "semi_join_topn_detail": _F.rstrip()
        + f", t as (select {pair} from f where proto = 6 group by all order by sum(bytes) desc, {pair} limit 10) "
        + f"select flow_id, file_id, {pair}, r.bytes from flow_records r semi join t using ({pair})",
        "window_topn": _W + f"select * from ({_top(['dstip_hi', 'dstip_lo'], 'flows')}) where rank <= 5",
        "msg_size_stability": _W
        + f"select \"window\", {pair}, count(*) = {AMP.sample} and coalesce(sum(cast(bytes <> before as integer)), 0) < {AMP.changes} as steady from "
        f"(select *, lag(bytes) over (partition by \"window\", {pair} order by no) as before from (select *, row_number() over (partition by \"window\", {pair} "
        f"order by first, last, bytes, packets, srcport, dstport) as no from w where srcport = {AMP.port} or dstport = {AMP.port}) where no <= {AMP.sample}) group by all",
        "detect_syn_flood": _syn_flood(_W, SYN),
        "detect_syn_flood_low": _syn_flood(_W, LOW_SYN),
        "detect_amplification": _amplification(_W, AMP),
        "detect_amplification_low": _amplification(_W, LOW_AMP),
        "list_limit": _F + "select least(50, count(*)) as shown, cast(0 as bigint) as wrong from f where srcport = 443 or dstport = 443",
        "limit_and_summary": _F + f"select {_SUMS}, least(7, count(distinct dstport)) as shown from f where proto = 17",
        "conv_volume": _F
        + "select proto, "
        + _volume("bytes", 1000, convert.METRIC)
        + " as bytes, "
        + _volume("packets", 1024, convert.BINARY)
        + " as packets from (select proto, sum(bytes) as bytes, sum(packets) as packets from f group by all)",
        "conv_address": _conv_address(),
    }
    return out


def _files(begin: int, end: int) -> str:
    return _F.replace("from flow_records)", f"from flow_records where file_id in (select file_id from flow_files where slot < {end} and slot + slot_seconds > {begin}))")


def _week(size: int) -> str:
    return _F.rstrip() + (
        f', w as (select *, least((first // 1000 - {BEGIN}) // {size}, {(END - BEGIN) // size - 1}) as "window" from f where first >= {BEGIN}000 and first < {END}000) '
    )


_W = _week(detect.WINDOW_SECONDS)


def _volume(c: str, by: int, units: list[str]) -> str:
    """Divided while larger than ``by``, with C's rounding to one decimal."""
    out = f"printf('%.1f', cast({c} as double)) || ' {units[0]}'"
    for i in range(1, 6):
        more = f"cast({c} as double)" + f" / {by}.0" * (i - 1)
        out = f"case when {more} > {by} then @ else {out} end" if i == 1 else out.replace("@", f"case when {more} > {by} then @ else printf('%.1f', {more}) || ' {units[i - 1]}' end")
    return out.replace("@", f"printf('%.1f', cast({c} as double)" + f" / {by}.0" * 5 + f") || ' {units[5]}'")


def _conv_address() -> str:
    """Networks of 16 and 48 bits: dotted, or three groups without the zeros at their end and the double colon."""
    wide = "(cast(hi as hugeint) + 18446744073709551616) % 18446744073709551616"
    groups = " || ':' || ".join(f"format('{{:x}}', cast({wide} // {2**by} % 65536 as bigint))" for by in (48, 32, 16))
    v4 = "hi = 0 and lo between 0 and 4294967295"
    return (
        _F + f"select case when {v4} and lo > 1 then (lo >> 24) || '.' || ((lo >> 16) & 255) || '.0.0' when hi = 0 then '::' else regexp_replace({groups}, '(:0)+$', '') || '::' end as network, "
        f"cast(sum(flows) as bigint) as flows from (select case when {v4.replace('hi', 'dstip_hi').replace('lo ', 'dstip_lo ')} then dstip_hi else dstip_hi & -65536 end as hi, "
        f"case when {v4.replace('hi', 'dstip_hi').replace('lo ', 'dstip_lo ')} then dstip_lo & 4294901760 else 0 end as lo, flows from f) group by hi, lo"
    )


def _top(keys: list[str], score: str, where: str = "") -> str:
    ks = ", ".join(keys)
    return (
        f'select *, cast(row_number() over (partition by "window" order by {score} desc, {ks}) as integer) as rank from '
        f'(select "window", {ks}, {_SUMS}, min(first) as first, max(last) as last from w {where} group by all)'
    )


def _syn_flood(week: str, p: detect.SynFlood) -> str:
    pair = detect.SRC + detect.DST
    keys = ", ".join(pair)
    return (
        week
        + f"select s.\"window\", {', '.join('s.' + c for c in pair)}, s.flows, s.packets, syn_packets, ack_packets from ({_top(pair, 'flows', 'where proto = 6')}) s join "
        f"(select \"window\", {keys}, cast(coalesce(sum(packets) filter (flags & 2 = 2 and flags & 17 = 0), 0) as bigint) as syn_packets, "
        f"cast(coalesce(sum(packets) filter (flags & 18 = 18 and flags & 1 = 0), 0) as bigint) as ack_packets from w where proto = 6 group by all) c using (\"window\", {keys}) "
        f"where rank <= {p.top} and flows >= {p.min_flows} and packets < {p.packets_per_flow} * flows and syn_packets > {p.ratio} * ack_packets"
    )


def _amplification(week: str, p: detect.Amplification) -> str:
    big = f"srcport = {p.port} and bytes // nullif(packets, 0) > {p.min_bpp} and packets > {p.min_packets} and packets < {p.max_packets}"
    dst, src = "dstip_hi, dstip_lo", "srcip_hi, srcip_lo"
    return (
        week.rstrip()
        + f", v as (select \"window\", {dst} from ({_top(['dstip_hi', 'dstip_lo'], 'flows', 'where ' + big)}) where rank <= {p.top} and "
        f"(bytes * 8000.0 / nullif(last - first, 0) >= {p.bps} or flows * 1000 / (last - first + 0.2) >= {p.flows_per_second})), "
        f's as (select "window", {dst}, {src}, row_number() over (partition by "window", {dst} order by packets desc, {src}) as rank from '
        f'(select "window", {dst}, {src}, sum(packets) as packets from w semi join v using ("window", {dst}) where {big} group by all)), '
        f't as (select *, max(rank) over (partition by "window", {dst}) as lowest from s where rank <= {p.top}), '
        f"e as (select *, 50 * (cast(rank = 1 as integer) + cast(rank = lowest as integer)) as share from t where rank = 1 or rank = lowest), "
        f'm as (select *, row_number() over (partition by "window", {dst}, {src} order by first, last, bytes, packets, srcport, dstport) as no from w semi join e using ("window", {dst}, {src}) '
        f"where srcport = {p.port} or dstport = {p.port}), "
        f'n as (select *, lag(bytes) over (partition by "window", {dst}, {src} order by no) as before from m where no <= {p.sample}), '
        f'k as (select "window", {dst}, {src} from n group by all having count(*) = {p.sample} and coalesce(sum(cast(bytes <> before as integer)), 0) < {p.changes}) '
        f'select "window", {dst}, cast(sum(share) as bigint) as reliability from e semi join k using ("window", {dst}, {src}) group by all'
    )


def _conversions() -> str:
    bits = " || ".join(f"case when flags & {1 << (7 - i)} <> 0 then '{x}' else '.' end" for i, x in enumerate(convert.FLAG_LETTERS))
    names = "case proto " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(convert.protocol_names())) + " end"
    v4 = " || '.' || ".join(f"cast((srcip_lo >> {by}) & 255 as varchar)" for by in (24, 16, 8, 0))
    word = lambda c, by: f"cast((cast(coalesce({c}, 0) as hugeint) + 18446744073709551616) % 18446744073709551616 // {2**by} % 4294967296 as varchar)"
    words = " || ':' || ".join(word(f"dstip_{h}", by) for h in ("hi", "lo") for by in (32, 0))
    d = "greatest(duration, 0)"
    hours = f"case when {d} // 3600000 > 99 then cast({d} // 3600000 as varchar) else lpad(cast({d} // 3600000 as varchar), 2, '0') end"
    part = lambda x, n: f"lpad(cast({x} as varchar), {n}, '0')"
    return (
        f"select flow_id, file_id, case when flags is not null then {bits} end as flags_text, {names} as proto_text, case when srcip_hi = 0 and srcip_lo between 0 and 4294967295 then {v4} end as src_v4, {words} as dst_words, "
        f"case when duration is null then '00:00:00.000' else {hours} || ':' || {part(f'{d} // 60000 % 60', 2)} || ':' || {part(f'{d} // 1000 % 60', 2)} || '.' || {part(f'{d} % 1000', 3)} end as duration_text, "
        "strftime(make_timestamp(first * 1000), '%Y-%m-%d %H:%M:%S.%g') as first_text from flow_records"
    )
