"""Flow records on disk: Parquet in slots of time, with Bloom filters and a manifest of headers.

A store is a folder with ``flows/day=D/slot=S/*.parquet`` and ``manifest/*.parquet``.  A slot is
the start, in epoch seconds, of the time a file covers; choosing a time is then a filter on
partition columns that never opens other files.  Bloom filters on the four address columns
let Parquet skip row groups that cannot hold an address searched for with ``=``.  The manifest
has the fifteen counters per slot, so summaries of it read no record.
"""

from __future__ import annotations

import socket
import warnings
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.plans.summary import counters
from flowloom.sources.tables import floor_div
from flowloom.sources.timespec import SLOT_SECONDS

ADDRESS_COLUMNS = ("srcip_hi", "srcip_lo", "dstip_hi", "dstip_lo")

SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("first", "last", "received", "bytes", "packets", "outbytes", "outpackets", "flows", *ADDRESS_COLUMNS)]
    + [T.StructField("srcport", T.IntegerType()), T.StructField("dstport", T.IntegerType())]
    + [T.StructField("proto", T.ShortType()), T.StructField("flags", T.ShortType())]
    + [T.StructField(n, T.LongType()) for n in ("input", "output", "insrcmac", "outdstmac")]
)


def with_slots(flows: DataFrame, by: str = "first", slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Adds day (days since 1970) and slot; records without the time go to day and slot null."""
    slot = floor_div(F.col(by), slot_seconds * 1000) * slot_seconds
    return flows.withColumn("slot", slot).withColumn("day", floor_div(F.col("slot"), 86_400))


def write_store(flows: DataFrame, path: str, by: str = "first", slot_seconds: int = SLOT_SECONDS, distinct_addresses: int = 100_000, mode: str = "overwrite") -> None:
    """Write records and their manifest.

    Rows of a slot are brought together first, a slot over several tasks where it is large
    (REBALANCE splits skewed slots), and sorted by address within files, so row groups differ in their addresses.
    """
    slotted = with_slots(flows, by, slot_seconds)
    out = slotted.hint("rebalance", "day", "slot").sortWithinPartitions("day", "slot", "srcip_lo", "srcip_hi").write.partitionBy("day", "slot").mode(mode)
    for c in ADDRESS_COLUMNS:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct_addresses))
    out.parquet(f"{path}/flows")
    written = flows.sparkSession.read.parquet(f"{path}/flows")
    counters(written, "day", "slot").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str, time: tuple[int, int] | None = None) -> DataFrame:
    """Records of a store, of the slots in [begin, end) if a time is given."""
    rows = spark.read.parquet(f"{path}/flows")
    return _in_time(rows, time)


def read_manifest(spark: SparkSession, path: str, time: tuple[int, int] | None = None) -> DataFrame:
    return _in_time(spark.read.parquet(f"{path}/manifest"), time)


def _in_time(rows: DataFrame, time: tuple[int, int] | None) -> DataFrame:
    if time is None:
        return rows
    begin, end = time
    return rows.where((F.col("day") >= begin // 86_400) & (F.col("day") <= (end - 1) // 86_400) & (F.col("slot") >= begin) & (F.col("slot") < end))


def expand(path: str) -> str | None:
    """A path with its directives filled in: ``%h`` is the host's name; null and a warning for any other.

    A path aimed at one of several readers (``%2:path``) has no meaning here, where Spark
    gives every file to exactly one task.
    """
    out, at = [], 0
    if path.startswith("%") and ":" in path and path[1 : path.index(":")].isdigit():
        raise ValueError(f"'{path}': paths for single readers are not supported; every file is read once")
    while at < len(path):
        if path[at] == "%":
            if path[at + 1 : at + 2] != "h":
                warnings.warn(f"unknown directive in path '{path}'; it is skipped", stacklevel=2)
                return None
            out.append(socket.gethostname())
            at += 2
        else:
            out.append(path[at])
            at += 1
    return "".join(out)


#: FAULTS: what a reader overlooks.  NO_INDEX: names of files in folders but those that begin with ``bfi.``, as a pattern of Hadoop.
FAULTS = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
NO_INDEX = "{[!b]*,b,b[!f]*,bf,bf[!i]*,bfi,bfi[!.]*}"


def _found(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, bool]]:
    """The paths there are, each with whether it is a folder; a warning for any other."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in filter(None, map(expand, paths)):
        where = jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(conf)
        if fs.exists(where):
            found.append((p, fs.getFileStatus(where).isDirectory()))
        else:
            warnings.warn(f"path '{p}' does not exist; it is left out", stacklevel=3)
    return found


def read_paths(spark: SparkSession, paths: Sequence[str], schema: T.StructType = SCHEMA, pattern: str = NO_INDEX) -> DataFrame:
    """All records of files and folders, folders with all they contain; a path given twice counts twice.

    Columns are those of the schema, null where a file lacks them; no footer is read to find out.
    Missing paths give a warning and are left out.  Files of any name are read but those that
    begin with ``bfi.`` (index files), by the pattern, and with ``.`` or ``_``, by Spark.  Corrupt files are left
    out; ``warn_of_silent`` names them.
    """
    if not paths:
        raise ValueError("at least one path is needed")
    found = _found(spark, paths)
    if not found:
        return spark.createDataFrame([], schema)
    # a reader takes each path once, so repeated ones need a reader each time they come
    rounds: dict[tuple[int, bool], list[str]] = {}
    seen: Counter = Counter()
    for p, is_folder in found:
        name = str(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
        rounds.setdefault((seen[name], is_folder), []).append(p)
        seen[name] += 1
    parts = [
        (spark.read.schema(schema).options(**FAULTS).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern) if is_folder else spark.read.schema(schema).options(**FAULTS)).parquet(*own)
        for (_, is_folder), own in rounds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def silent_files(rows: DataFrame) -> list[str]:
    """Files of a DataFrame of ``read_paths`` that give no record: corrupt, or empty.  Tasks count records, which Parquet's footers tell."""
    names = set(rows.inputFiles())
    told = rows.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    spark = rows.sparkSession
    listed = spark.createDataFrame([(n,) for n in sorted(names)], "file string")
    return sorted(r.file for r in listed.join(told, "file", "left_anti").collect())


def warn_of_silent(spark: SparkSession, paths: Sequence[str], rows: DataFrame) -> list[str]:
    """Warn of files without a record, and of those in folders whose names Spark does not read."""
    silent = silent_files(rows)
    for name in silent:
        warnings.warn(f"file '{name}' is corrupt or empty; it is left out", stacklevel=2)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in filter(None, map(expand, paths)):
        where = jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(conf)
        if fs.exists(where) and fs.getFileStatus(where).isDirectory():
            for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(where, "{,*/,*/*/}_*.parquet")) or []:
                warnings.warn(f"file '{x.getPath()}' begins with an underscore; it is left out", stacklevel=2)
                silent.append(str(x.getPath()))
    return silent
