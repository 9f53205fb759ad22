"""Intermediate tables in the folder that all executors share.

A staged table cuts the lineage: an executor that is lost later costs no more than
reading the table again.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only where that is unset, and only in local mode, where all executors are
on this machine, do we choose a temporary one ourselves.  On a cluster without the setting staging
refuses to work, as no folder of a single machine would do.

Staged tables go when the program ends, or as soon as the caller of ``staged_within`` is done.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_PATHS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="flowloom-")
        atexit.register(shutil.rmtree, _OWN[app].removeprefix("file://"), True)
    return _OWN[app]


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder belongs to the cluster
        pass


def own_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed like a staged table."""
    path = f"{shared_folder(spark)}/flowloom-{label}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    if len(_PATHS) == 1:
        atexit.register(free, spark, 0)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return it as a scan of what was written."""
    spark = df.sparkSession
    path = own_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession, upto: int) -> None:
    """Remove the tables staged since there were ``upto`` of them."""
    while len(_PATHS) > upto:
        remove(spark, _PATHS.pop())


@contextmanager
def staged_within(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end; results have to be written or collected by then."""
    before = len(_PATHS)
    try:
        yield
    finally:
        free(spark, before)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, however the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="flowloom-ship-"), "flowloom_ship.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("flowloom", os.path.relpath(full, home)))
    spark.sparkContext.addPyFile(archive)
