"""Command line: one call, one query.

    python -m flowloom.cli -s srcip,proto -f "dst port in [80 443]" /data/flows

Options that are given again replace earlier ones, ``-s`` counting as ``-a``, ``-o`` and ``-l 10``
at the place where it stands.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
import threading
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowloom import __version__
from flowloom.plans import render, summary
from flowloom.plans.filterlang import parse
from flowloom.plans.query import FlowQuery
from flowloom.sources import store, timespec

ITEMS = {"r": "records", "p": "processed-records-summary", "m": "metadata-summary"}


class _InOrder(argparse.Action):
    """Keeps query options in the order they were given in."""

    def __call__(self, parser, namespace, value, option=None):
        namespace.steps.append((self.dest, value))


class _Parser(argparse.ArgumentParser):
    """Bad options are errors like any other, so they end with status 1."""

    def error(self, message: str) -> None:
        raise ValueError(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="flowloom", description="Query files of IP flow records.", allow_abbrev=True)
    p.set_defaults(steps=[])
    p.add_argument("paths", nargs="+", metavar="path")
    p.add_argument("-a", "--aggregation", action=_InOrder)
    p.add_argument("-f", "--filter", action=_InOrder)
    p.add_argument("-l", "--limit", action=_InOrder)
    p.add_argument("-o", "--order", action=_InOrder)
    p.add_argument("-s", "--statistic", action=_InOrder)
    p.add_argument("-t", "--time-point")
    p.add_argument("-T", "--time-range")
    p.add_argument("-v", "--verbosity", type=int, choices=range(5), default=2)
    p.add_argument("--output-fields", action=_InOrder)
    p.add_argument("--output-items")
    p.add_argument("--output-format", choices=("pretty", "csv"), default="pretty")
    p.add_argument("--output-rich-header", action="store_true")
    p.add_argument("--output-no-ellipsize", action="store_true")
    for name in ("ts", "volume", "tcpflags", "addr", "proto", "duration"):
        p.add_argument(f"--output-{name}-conv")
    p.add_argument("--progress-bar-type", choices=("none", "total", "perslave", "json"), default="total")
    p.add_argument("--progress-bar-dest", default="stderr")
    p.add_argument("--num-threads", type=int)
    p.add_argument("--time-zone")
    p.add_argument("--no-tput", action="store_true", help="accepted; the plan is the same, exact one either way")
    p.add_argument("--no-bfindex", action="store_true", help="do not use Parquet's Bloom filters")
    p.add_argument("--version", action="version", version=f"flowloom {__version__}")
    return p


def query_of(steps: list[tuple[str, str]]) -> FlowQuery:
    """The query of options in the order given."""
    q = FlowQuery()
    for name, value in steps:
        if name == "limit":
            if not value.isdigit():
                raise ValueError(f"invalid limit '{value}'")
            q = q.limit(int(value))
        else:
            step = {"aggregation": q.aggregate, "filter": q.where, "order": q.order_by, "statistic": q.statistic, "output_fields": q.select}[name]
            q = step(value)
    return q


def items_of(text: str | None, form: str) -> list[str]:
    if text is None:
        return ["r", "p"] if form == "pretty" else ["r"]
    found = []
    for word in text.split(","):
        short = word if word in ITEMS else next((k for k, v in ITEMS.items() if v == word), None)
        if short is None:
            raise ValueError(f"unknown output item '{word}'")
        found.append(short)
    return [x for x in "rpm" if x in found]


def time_of(args) -> tuple[int, int] | None:
    if args.time_point and args.time_range:
        raise ValueError("time point and time range exclude each other")
    if args.time_point:
        return timespec.point(args.time_point, args.time_zone)
    return timespec.span(args.time_range, args.time_zone) if args.time_range else None


def read(spark: SparkSession, paths: list[str], when: tuple[int, int] | None) -> tuple[DataFrame, DataFrame]:
    """(records, headers) of paths: stores this package wrote by slot, anything else as plain Parquet, which a time does not restrict."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    records, headers, plain = [], [], []
    for p in filter(None, map(store.expand, paths)):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/manifest")
        if where.getFileSystem(conf).exists(where):
            records.append(store.read_store(spark, p, when))
            headers.append(store.read_manifest(spark, p, when))
        else:
            plain.append(p)
    if plain:
        rows = store.read_paths(spark, plain)
        store.warn_of_silent(spark, plain, rows)
        records.append(rows)
        headers.append(summary.counters(rows))
    join = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(join(dfs[1:]), allowMissingColumns=True)
    return join(records), join(headers)


class Progress(threading.Thread):
    """Share of tasks done, from the status tracker, to a stream or a file rewritten each time."""

    def __init__(self, spark: SparkSession, kind: str, to: str):
        super().__init__(daemon=True)
        self.tracker, self.kind, self.to, self.over = spark.sparkContext.statusTracker(), kind, to, threading.Event()

    def state(self) -> dict[str, int]:
        """Percent of tasks done in all, and of each stage that runs."""
        done = whole = 0
        each = {}
        for job in self.tracker.getActiveJobsIds():
            info = self.tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = self.tracker.getStageInfo(stage)
                if s:
                    done, whole = done + s.numCompletedTasks, whole + s.numTasks
                    each[f"stage{stage}"] = 100 * s.numCompletedTasks // max(1, s.numTasks)
        return {"total": 100 * done // whole if whole else 0} | (each if self.kind in ("perslave", "json") else {})

    def show(self, state: dict[str, int]) -> None:
        text = json.dumps(state) if self.kind == "json" else "reading records: " + ", ".join(f"{k} {v} %" for k, v in state.items())
        if self.to in ("stderr", "stdout"):
            print(text, file=getattr(sys, self.to), flush=True)
        else:
            with open(self.to, "w") as f:
                f.write(text + "\n")

    def run(self) -> None:
        last = None
        while not self.over.wait(0.5):
            if (now := self.state()) != last:
                self.show(now)
                last = now
        self.show({"total": 100})


def run(spark: SparkSession, args, out=sys.stdout) -> None:
    query, items, when = query_of(args.steps), items_of(args.output_items, args.output_format), time_of(args)
    zone = args.time_zone or "UTC"
    style = render.style(
        args.output_format, time=args.output_ts_conv, volume=args.output_volume_conv, flags=args.output_tcpflags_conv, address=args.output_addr_conv,
        proto=args.output_proto_conv, duration=args.output_duration_conv, zone=spark.sparkContext._jvm.java.time.ZoneId.systemDefault().getId() if zone == "system" else zone,
        rich=args.output_rich_header, ellipsize=not args.output_no_ellipsize,
    )
    began = time.time()
    records, headers = read(spark, args.paths, when)
    if "flows" not in records.columns:
        records = records.withColumn("flows", F.lit(1).cast("long"))
    printed = False

    def put(lines) -> None:
        nonlocal printed
        if printed:
            print(file=out)
        printed = True
        for line in lines:
            print(line, file=out)

    bar = Progress(spark, args.progress_bar_type, args.progress_bar_dest) if args.progress_bar_type != "none" and items != ["m"] else None
    if bar:
        bar.start()
    try:
        # where the result needs all matching records anyway, they are summed up in the same pass
        seen = Observation("processed") if {"r", "p"} <= set(items) and query.whole_input else None
        if "r" in items:
            put(render.lines(query.run(records, seen), query, style))
        if "p" in items:
            sums = seen.get if seen else summary.processed(query.matching(records)).first().asDict()
            put(render.processed_lines(sums["flows"], sums["packets"], sums["bytes"], time.time() - began, style))
        if "m" in items:
            put(render.metadata_lines(summary.metadata(headers).collect(), style))
    finally:
        if bar:
            bar.over.set()
            bar.join()


def main(argv: list[str] | None = None) -> int:
    log = logging.getLogger("flowloom")
    try:
        args = parser().parse_args(argv)
    except ValueError as e:
        log.error("%s", e)
        return 1
    logging.basicConfig(level=[logging.CRITICAL, logging.ERROR, logging.WARNING, logging.INFO, logging.DEBUG][args.verbosity])
    try:
        for name, value in args.steps:
            if name == "filter":
                parse(value)
        if args.num_threads is not None and args.num_threads < 1:
            raise ValueError("the number of threads must be positive")
        builder = SparkSession.builder.appName("flowloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        if args.num_threads:
            builder = builder.master(f"local[{args.num_threads}]")
        spark = builder.getOrCreate()
        spark.conf.set("spark.sql.parquet.filterPushdown", "true")
        if args.no_bfindex:
            spark.sparkContext._jsc.hadoopConfiguration().set("parquet.filter.bloom.enabled", "false")
        run(spark, args)
    except ValueError as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
