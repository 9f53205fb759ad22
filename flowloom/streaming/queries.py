"""The driver's queries of the streaming operators: what is final once all there is at the time of the call has come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.queries import in_time
from flowloom.sources.tables import flow_records, present
from flowloom.staging import own_folder, remove
from flowloom.streaming.sessions import stream_sessions, stream_totals

GAP_MS = 1_800_000
LATENESS, LATENESS_MS = "6 hours", 21_600_000


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    # a pattern, as a stream's plain path must be a folder and the table may be one file
    return spark.readStream.schema(flow_records(spark, sf).schema).parquet(f"{sf}/flow_records.parque[t]")


def _run(df: DataFrame, path: str) -> None:
    """What there is of a stream now into a folder, each row exactly once over all runs."""
    query = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()


def _result(df: DataFrame, path: str) -> DataFrame:
    """The rows of a stream that has ended; its state is removed now, they are with the staged tables."""
    remove(df.sparkSession, f"{path}/state")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def drained(df: DataFrame) -> DataFrame:
    """A streaming result over all input present."""
    path = own_folder(df.sparkSession, "stream")
    _run(df, path)
    return _result(df, path)


def stream_found_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Records come as they arrived, a day's at a time, and the stream ends and resumes in between.

    Late ones extend and bridge open sessions; those that start no later than the watermark the earlier
    days have left are dropped.  Sessions that the last watermark has not passed stay open.
    """
    path, rows = own_folder(spark, "stream"), flow_records(spark, sf)
    day = F.call_function("div", F.col("received"), F.lit(86_400_000).cast("long"))
    rows.withColumn("delivery", day).write.partitionBy("delivery").parquet(f"{path}/waiting")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path
    fs = folder(path).getFileSystem(conf)
    fs.mkdirs(folder(f"{path}/in"))

    def sessions() -> DataFrame:
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        return stream_sessions(stream.where(present("srcip")), ["srcip_hi", "srcip_lo"], "first", "duration", GAP_MS, LATENESS, identity="flow_id")

    waiting = [x.getPath() for x in fs.listStatus(folder(f"{path}/waiting")) if x.getPath().getName().startswith("delivery=")]
    for delivery in sorted(waiting, key=lambda p: int(p.getName().removeprefix("delivery="))):
        fs.rename(delivery, folder(f"{path}/in/{delivery.getName().removeprefix('delivery=')}"))
        _run(sessions(), path)
    return _result(sessions(), path)


def stream_hourly_totals(spark: SparkSession, sf: str) -> DataFrame:
    return drained(stream_totals(_stream(spark, sf), ["proto"], "first", "1 hour", LATENESS))


def stream_sliding_totals(spark: SparkSession, sf: str) -> DataFrame:
    return drained(stream_totals(_stream(spark, sf), ["exporter_id"], "first", "2 hours", LATENESS, "1 hour"))


def queries() -> dict:
    return {f.__name__: f for f in (stream_found_sessions, stream_hourly_totals, stream_sliding_totals)}


def oracle_sql() -> dict[str, str]:
    here = "srcip_hi is not null and srcip_lo is not null and (srcip_hi <> 0 or srcip_lo <> 0)"
    sums = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("flows", "packets", "bytes"))
    final = f"(select max(first) from flow_records) - {LATENESS_MS}"
    return {
        "stream_found_sessions": f"""
with f as (select distinct flow_id, srcip_hi, srcip_lo, first as s, first + greatest(coalesce(duration, 0), 0) as e from {in_time(LATENESS_MS)}),
r as (select *, max(e) over (partition by srcip_hi, srcip_lo order by s, e, flow_id rows between unbounded preceding and 1 preceding) as reach from f),
n as (select *, sum(case when reach is null or s - reach > {GAP_MS} then 1 else 0 end) over (partition by srcip_hi, srcip_lo order by s, e, flow_id rows unbounded preceding) as no from r),
x as (select srcip_hi, srcip_lo, min(s) as session_start, max(e) as session_end, max(e) - min(s) as session_duration, cast(count(*) as bigint) as events from n group by srcip_hi, srcip_lo, no)
select * from x where session_end + {GAP_MS} <= (select max(first) from flow_records where {here}) - {LATENESS_MS}""",
        "stream_hourly_totals": f"select w as window_start, w + 3600000 as window_end, proto, {sums} from (select *, first // 3600000 * 3600000 as w from flow_records "
        f"where first is not null) group by all having w + 3600000 <= {final}",
        "stream_sliding_totals": f"select w as window_start, w + 7200000 as window_end, exporter_id, {sums} from (select *, unnest([first // 3600000 * 3600000, first // 3600000 * 3600000 - 3600000]) as w "
        f"from flow_records where first is not null) group by all having w + 7200000 <= {final}",
    }
