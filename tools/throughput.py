"""python tools/throughput.py [--sf DIR] [--copies 164] [--cores 8]: flows a second of typical queries over a table read many times."""

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from flowloom.plans.query import FlowQuery  # noqa: E402
from flowloom.sources import store  # noqa: E402

QUERIES = {
    "list_net": FlowQuery().where("net 172.16.0.0/12").select("first,bytes"),
    "sort_bytes": FlowQuery().order_by("bytes").limit(5),
    "aggr_srcport": FlowQuery().aggregate("srcport"),
    "aggr_srcip": FlowQuery().aggregate("srcip").select("first,flows,packets,bytes"),
    "stat_srcip_proto": FlowQuery().statistic("srcip,proto"),
    "stat_bytes": FlowQuery().statistic("bytes"),
    "stat_ports_tcp": FlowQuery().where("proto TCP").statistic("srcport,dstport"),
    "stat_pairs": FlowQuery().statistic("srcip,dstip#bytes"),
}


def main(argv: list[str]) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.1")
    p.add_argument("--copies", type=int, default=164)
    p.add_argument("--cores", type=int, default=8)
    args = p.parse_args(argv)
    spark = (
        SparkSession.builder.master(f"local[{args.cores}]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(args.cores)).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.schema(store.SCHEMA).parquet(*[f"{args.sf}/flow_records.parquet"] * args.copies)
    flows = rows.count()
    for name, query in QUERIES.items():
        took = []
        for _ in range(2):
            began = time.time()
            query.run(rows).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        print(json.dumps({"query": name, "flows": flows, "seconds": round(min(took), 3), "flows_per_second": round(flows / min(took))}), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
