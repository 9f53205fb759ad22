"""The driver's queries of sources: folders of files, stores of slots, words for times; and their SQL.

What they read is written first, into the folder of ``flowloom.staging``, from the whole table.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.plans import summary
from flowloom.plans.query import FlowQuery
from flowloom.sources import store, timespec
from flowloom.sources.tables import flow_records
from flowloom.staging import own_folder

SLOT = 3600
RANGE = "2024-03-05 12:30#2024-03-06 00:10"
ADDRESS = "10.77.56.49"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    rows = flow_records(spark, sf)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in store.SCHEMA if f.name in rows.columns])


def _copied(spark: SparkSession, source: str, to: str) -> None:
    """The first data file of a folder under another name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(conf)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, fs.globStatus(path(f"{source}/part-*"))[0].getPath(), fs, path(to), False, conf)


def read_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Records by protocol of: a folder with folders in it, a folder given twice, a missing path; hidden, index and corrupt files are in the way."""
    base, rows = own_folder(spark, "paths"), _records(spark, sf)
    rows.where("proto = 6").write.parquet(f"{base}/a")
    rows.where("proto = 17").write.parquet(f"{base}/a/deep/er")
    rows.where("proto = 1").write.parquet(f"{base}/b")
    for name in (".hidden.parquet", "bfi.flows"):
        _copied(spark, f"{base}/a", f"{base}/a/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    broken = jvm.org.apache.hadoop.fs.Path(f"{base}/a/broken")
    out = broken.getFileSystem(conf).create(broken)
    out.writeBytes("no records here")
    out.close()
    found = store.read_paths(spark, [f"{base}/a", f"{base}/b", f"{base}/missing", f"{base}/b"])
    return found.groupBy("proto").agg(F.count(F.lit(1)).alias("records"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def read_files(spark: SparkSession, sf: str) -> DataFrame:
    """Single files are read whatever they are called."""
    base = own_folder(spark, "files")
    _records(spark, sf).coalesce(1).write.parquet(f"{base}/made")
    for name in ("flows.0", "x"):
        _copied(spark, f"{base}/made", f"{base}/{name}")
    return FlowQuery().aggregate("proto").select("flows,bytes").run(store.read_paths(spark, [f"{base}/flows.0", f"{base}/x"]))


def _store(spark: SparkSession, sf: str) -> str:
    base = own_folder(spark, "store")
    store.write_store(_records(spark, sf), base, slot_seconds=SLOT)
    return base


def store_time_range(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of a range of time, chosen by partition columns."""
    return FlowQuery().statistic("srcip#bytes").select("flows,packets").run(store.read_store(spark, _store(spark, sf), timespec.span(RANGE, slot=SLOT)))


def store_time_point(spark: SparkSession, sf: str) -> DataFrame:
    return FlowQuery().aggregate("proto").select("flows,bytes").run(store.read_store(spark, _store(spark, sf), timespec.point("2024-03-06 10:02", slot=SLOT)))


def store_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of the headers of a range; no record is read."""
    return summary.metadata(store.read_manifest(spark, _store(spark, sf), timespec.span(RANGE, slot=SLOT)))


def store_address(spark: SparkSession, sf: str) -> DataFrame:
    """Records of an address, from a store whose row groups tell by Bloom filters whether they can have it."""
    return FlowQuery().where(f"ip {ADDRESS}").select("first,bytes,srcip,dstip").run(store.read_store(spark, _store(spark, sf)))


NOW = datetime(2024, 3, 6, 10, 30, tzinfo=timezone.utc)  # a Wednesday
#: Words for times, the zone they are in, and what they mean at that moment, in UTC.
WORDS = [
    ("2024-02-29", None, "2024-02-29 00:00:00"),
    ("29.02.2024 7:05", None, "2024-02-29 07:05:00"),
    ("07:05 02/29/2024", None, "2024-02-29 07:05:00"),
    ("1709720000", None, "2024-03-06 10:13:20"),
    ("1700000000 10:30", None, "2023-11-14 10:30:20"),
    ("wed", None, "2024-03-06 00:00:00"),
    ("Thursday", None, "2024-02-29 00:00:00"),
    ("tue 12:15", None, "2024-03-05 12:15:00"),
    ("march", None, "2024-03-01 00:00:00"),
    ("Apr", None, "2023-04-01 00:00:00"),
    ("Mon March", None, "2024-03-01 00:00:00"),
    ("2024-03-06 May", None, "2024-05-06 00:00:00"),
    ("10:45", None, "2024-03-06 10:45:00"),
    ("11:00", None, "2024-03-05 11:00:00"),
    ("2024-07-01 12:00", "Europe/Prague", "2024-07-01 10:00:00"),
]
#: Ranges and the first and last slot of 300 s they mean.
SPANS = [
    ("2024-03-06 10:07#2024-03-06 10:11", "2024-03-06 10:05:00", "2024-03-06 10:15:00"),
    ("2024-03-06", "2024-03-06 00:00:00", "2024-03-06 10:30:00"),
    ("tue#wed", "2024-03-05 00:00:00", "2024-03-06 00:00:00"),
]


def time_words(spark: SparkSession, sf: str) -> DataFrame:
    """What words for times mean, and the records of the week that begin before."""
    points = [(w, z or "", timespec.parse_time(w, z, NOW), 0) for w, z, _ in WORDS]
    spans = [(w, "", *timespec.span(w, now=NOW)) for w, _, _ in SPANS]
    said = [
        F.struct(*[F.lit(x).cast(t).alias(n) for x, t, n in zip(row, ("string", "string", "long", "long"), ("words", "zone", "begins", "ends"))], F.count(F.when(F.col("first") < row[2] * 1000, 1)).alias("earlier"))
        for row in (*points, *spans)
    ]
    return flow_records(spark, sf).agg(F.array(*said).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def queries() -> dict:
    return {f.__name__: f for f in (read_folders, read_files, store_time_range, store_time_point, store_headers, store_address, time_words)}


def oracle_sql() -> dict[str, str]:
    from flowloom.plans.flow_queries import _F, _SUMS, _where

    slot = f"cast(floor(first / {SLOT}000) as bigint) * {SLOT}"
    (a, b), (c, d) = timespec.span(RANGE, slot=SLOT), timespec.point("2024-03-06 10:02", slot=SLOT)
    within = lambda x, y: f"where first is not null and {slot} >= {x} and {slot} < {y}"
    flows = lambda x, y: _F.replace("from flow_records)", f"from flow_records {within(x, y)})")
    seconds = lambda t: f"cast(epoch(timestamp '{t}') as bigint)"
    said = [f"('{w}', '{z or ''}', {seconds(t)}, cast(0 as bigint))" for w, z, t in WORDS] + [f"('{w}', '', {seconds(t)}, {seconds(u)})" for w, t, u in SPANS]
    return {
        "read_folders": "select proto, cast(count(*) as bigint) as records, cast(sum(coalesce(bytes, 0)) as bigint) as bytes from (select proto, bytes from flow_records where proto in (1, 6, 17) "
        "union all select proto, bytes from flow_records where proto = 1) group by all",
        "read_files": _F + "select proto, cast(2 * sum(flows) as bigint) as flows, cast(2 * sum(bytes) as bigint) as bytes from f group by all",
        "store_time_range": flows(a, b)
        + "select srcip_hi, srcip_lo, bytes, flows, packets from "
        + f"(select srcip_hi, srcip_lo, {_SUMS} from f group by all) order by bytes desc, srcip_hi, srcip_lo, flows, packets limit 10",
        "store_time_point": flows(c, d) + "select proto, cast(sum(flows) as bigint) as flows, cast(sum(bytes) as bigint) as bytes from f group by all",
        "store_headers": flows(a, b)
        + " union all ".join(
            f"select '{m}' as field, cast(coalesce(sum({m}), 0) as bigint) as total, cast(coalesce(sum({m}) filter (proto = 6), 0) as bigint) as tcp, cast(coalesce(sum({m}) filter (proto = 17), 0) as bigint) as udp, "
            f"cast(coalesce(sum({m}) filter (proto = 1), 0) as bigint) as icmp, cast(coalesce(sum({m}) filter (proto not in (1, 6, 17)), 0) as bigint) as other from f"
            for m in summary.MEASURES
        ),
        "store_address": _F + "select first, bytes, srcip_hi, srcip_lo, dstip_hi, dstip_lo from f where " + _where("S(172832817,172832817) or D(172832817,172832817)"),
        "time_words": f"select words, zone, begins, ends, cast((select count(*) from flow_records where first < begins * 1000) as bigint) as earlier from (values {', '.join(said)}) as t(words, zone, begins, ends)",
    }
