"""python tools/sweep.py [--sf DIR] [--cores 1,2,4] [--runs 3]: every filter of the corpus with a number of cores, several times.

Prints a CSV line per filter and number of cores: number of the filter, cores, flows, packets, bytes, mean and spread of the
seconds, flows a second.  Ends with 1 if the sums of a filter are not the same in every run.
"""

import argparse
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from flowloom.plans import summary  # noqa: E402
from flowloom.plans.flow_queries import CORPUS  # noqa: E402
from flowloom.plans.query import FlowQuery  # noqa: E402
from flowloom.sources.tables import flow_records  # noqa: E402


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--cores", default="1,2,4")
    p.add_argument("--runs", type=int, default=3)
    p.add_argument("--filters", type=int, default=len(CORPUS), help="so many of them, from the first")
    args = p.parse_args(argv)
    sums: dict[str, set] = {}
    print("filter,cores,flows,packets,bytes,seconds,spread,flows/second")
    for cores in map(int, args.cores.split(",")):
        spark = (
            SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        rows = flow_records(spark, args.sf)
        rows.count()
        for i, text in enumerate(list(CORPUS)[: args.filters]):
            took = []
            for _ in range(args.runs):
                began = time.time()
                found = tuple(summary.processed(FlowQuery().where(text).matching(rows)).first())
                took.append(time.time() - began)
                sums.setdefault(text, set()).add(found)
            mean = statistics.mean(took)
            print(f"{i},{cores},{','.join(map(str, found))},{mean:.4f},{statistics.pstdev(took):.4f},{found[0] / mean:.1f}", flush=True)
        spark.stop()
    unequal = [text for text, found in sums.items() if len(found) > 1]
    for text in unequal:
        print(f"sums differ: {text}", file=sys.stderr)
    return bool(unequal)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
