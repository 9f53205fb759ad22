"""The driver's queries of results as text, and their SQL: every line is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import convert, ip
from flowloom.plans import render, summary
from flowloom.plans.query import FlowQuery
from flowloom.sources.tables import flow_records, table

CSV, PRETTY = render.style("csv"), render.style("pretty", rich=True)
TOP = FlowQuery().where("not port 0").statistic("proto#bytes").select("flows,packets,bpp")
ALIGNED = FlowQuery().aggregate("proto").order_by("bytes#desc").limit(5).select("first,flows,flags")


def _numbered(spark: SparkSession, lines) -> DataFrame:
    """Lines of a small result with their numbers."""
    return spark.createDataFrame(list(enumerate(lines)), "no bigint, line string")


def csv_top(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, render.lines(TOP.run(flow_records(spark, sf)), TOP, CSV))


def aligned_top(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned columns under a rich header."""
    return _numbered(spark, render.lines(ALIGNED.run(flow_records(spark, sf)), ALIGNED, PRETTY))


def csv_records(spark: SparkSession, sf: str) -> DataFrame:
    """All records as CSV, written where they are."""
    query = FlowQuery().select("first,duration,bytes,packets,srcip,dstip,srcport,dstport,proto,flags,bps")
    return render.csv_lines(query.run(flow_records(spark, sf)), query, CSV)


def csv_basic_records(spark: SparkSession, sf: str) -> DataFrame:
    query = FlowQuery().where("proto UDP").select(",".join(render.BASIC))
    return render.csv_lines(query.run(flow_records(spark, sf)), query, CSV)


def csv_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Both summaries as the command line prints them, over two seconds."""
    sums = summary.processed(FlowQuery().where("proto TCP").matching(flow_records(spark, sf))).first()
    headers = summary.metadata(table(spark, sf, "flow_files")).collect()
    return _numbered(spark, [*render.processed_lines(sums.flows, sums.packets, sums.bytes, 2.0, CSV), "", *render.metadata_lines(headers, CSV)])


def aligned_summaries(spark: SparkSession, sf: str) -> DataFrame:
    headers = summary.metadata(table(spark, sf, "flow_files")).collect()
    return _numbered(spark, render.metadata_lines(headers, PRETTY))


def conv_mac(spark: SparkSession, sf: str) -> DataFrame:
    """The low six bytes of an address as a hardware address."""
    return flow_records(spark, sf).select("flow_id", "file_id", convert.mac_text(F.col("srcip_lo").bitwiseAND(F.lit(2**48 - 1))).alias("mac"))


def conv_full_address(spark: SparkSession, sf: str) -> DataFrame:
    """Every destination as text, IPv6 ones with their longest run of zeros shortened."""
    found = FlowQuery().aggregate("dstip").select("flows").run(flow_records(spark, sf))
    return found.select("dstip_hi", "dstip_lo", ip.text(F.col("dstip_hi"), F.col("dstip_lo")).alias("address"), "flows")


def queries() -> dict:
    return {f.__name__: f for f in (csv_top, aligned_top, csv_records, csv_basic_records, csv_summaries, aligned_summaries, conv_mac, conv_full_address)}


def oracle_sql() -> dict[str, str]:
    from flowloom.plans.flow_queries import _F, _SUMS, _volume  # the records with zeros, and SQL of the conversions

    text = lambda *cs: " || ',' || ".join(f"cast({c} as varchar)" for c in cs)
    words = lambda x: " || ':' || ".join(
        f"cast((cast({x}_{h} as hugeint) + 18446744073709551616) % 18446744073709551616 // {2**by} % 4294967296 as varchar)" for h in ("hi", "lo") for by in (32, 0)
    )
    parts = ["", "_tcp", "_udp", "_icmp", "_other"]
    sums = ", ".join(f"cast(sum(coalesce({m}{c}, 0)) as bigint) as {m}{c}" for m in summary.MEASURES for c in parts)
    names = "case proto " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(convert.protocol_names())) + " end"
    bits = " || ".join(f"case when flags & {1 << (7 - i)} <> 0 then '{x}' else '.' end" for i, x in enumerate(convert.FLAG_LETTERS))
    titles = [("total:", ""), ("TCP:", "_tcp"), ("UDP:", "_udp"), ("ICMP:", "_icmp"), ("other:", "_other")]
    tab = "chr(9)"
    wide = lambda h: f"(cast(dstip_{h} as hugeint) + 18446744073709551616) % 18446744073709551616"
    groups = " || ':' || ".join(f"format('{{:x}}', cast({wide(h)} // {2**by} % 65536 as bigint))" for h in ("hi", "lo") for by in (48, 32, 16, 0))
    runs = [f"(^|:)0(:0){{{n - 1}}}(:|$)" for n in range(8, 1, -1)]  # the longest first, of equal ones the leftmost
    v6 = "case " + " ".join(f"when regexp_matches(g, '{r}') then regexp_replace(g, '{r}', '::')" for r in runs) + " else g end"
    dotted = " || '.' || ".join(f"((dstip_lo >> {by}) & 255)" for by in (24, 16, 8, 0))
    return {
        "csv_top": _F
        + f"select cast(0 as bigint) as no, 'proto,bytes,flows,packets,bpp' as line union all select row_number() over (order by bytes desc, proto, flows, packets), "
        + text("proto", "bytes", "flows", "packets")
        + " || ',' || coalesce(printf('%.1f', floor(bytes / nullif(packets, 0))), 'NaN') from (select * from "
        + f"(select proto, {_SUMS} from f where not (srcport = 0 or dstport = 0) group by all) order by bytes desc, proto, flows, packets limit 10)",
        "aligned_top": _F
        + "select cast(0 as bigint) as no, 'proto (key)    ' || lpad('bytes {desc}', 12, ' ') || '    ' || rpad('first [min]', 23, ' ') || '    flows [sum]    flags [or]' as line union all "
        + f"select row_number() over (order by b desc, proto), rpad({names}, 11, ' ') || '    ' || lpad({_volume('b', 1000, convert.METRIC)}, 12, ' ') || '    ' || "
        + f"strftime(make_timestamp(start * 1000), '%Y-%m-%d %H:%M:%S.%g') || '    ' || lpad({_volume('n', 1000, convert.METRIC)}, 11, ' ') || '    ' || {bits} from "
        + "(select proto, sum(bytes) as b, min(first) as start, sum(flows) as n, bit_or(flags) as flags from f group by all order by b desc, proto limit 5)",
        "csv_records": _F
        + "select "
        + text("first", "last - first", "bytes", "packets")
        + f" || ',' || {words('srcip')} || ',' || {words('dstip')} || ',' || "
        + text("srcport", "dstport", "proto", "flags")
        + " || ',' || coalesce(printf('%.1f', cast(bytes as double) * 8000.0 / nullif(last - first, 0)), 'NaN') as line from f",
        "csv_basic_records": _F
        + "select "
        + text("first", "last", "proto")
        + f" || ',' || {words('srcip')} || ',' || cast(srcport as varchar) || ',' || {words('dstip')} || ',' || "
        + text("dstport", "bytes", "packets", "flows")
        + " as line from f where proto = 17",
        "csv_summaries": _F.rstrip()
        + f", p as (select {_SUMS} from f where proto = 6), m as (select {sums} from flow_files) "
        + "select cast(0 as bigint) as no, 'flows,packets,bytes,seconds,flows/second' as line union all select 1, "
        + text("flows", "packets", "bytes")
        + " || ',2.000000,' || printf('%.1f', flows / 2.0) from p union all select 2, '' union all select 3, 'field,total,TCP,UDP,ICMP,other' union all "
        + " union all ".join(f"select {4 + i}, '{m},' || " + text(*(m + c for c in parts)) + " from m" for i, m in enumerate(summary.MEASURES)),
        "aligned_summaries": f"with m as (select {sums} from flow_files) select cast(0 as bigint) as no, 'metadata summary:' as line union all "
        + " union all ".join(
            f"select {1 + 6 * i}, {tab} || '{m}:' union all "
            + " union all ".join(f"select {2 + 6 * i + j}, {tab} || {tab} || rpad('{t}', 6, ' ') || ' ' || {_volume(m + c, 1000, convert.METRIC)} from m" for j, (t, c) in enumerate(titles))
            for i, m in enumerate(summary.MEASURES)
        ),
        "conv_full_address": _F
        + f"select dstip_hi, dstip_lo, case when dstip_hi = 0 and dstip_lo between 2 and 4294967295 then {dotted} when dstip_hi = 0 and dstip_lo >> 32 = 65535 then '::ffff:' || {dotted} else {v6} end as address, flows "
        f"from (select dstip_hi, dstip_lo, {groups} as g, cast(sum(flows) as bigint) as flows from f group by all)",
        "conv_mac": "select flow_id, file_id, " + " || ':' || ".join(f"format('{{:02x}}', (srcip_lo >> {by}) & 255)" for by in (40, 32, 24, 16, 8, 0)) + " as mac from flow_records",
    }
