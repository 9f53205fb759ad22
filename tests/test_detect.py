import random

import pytest
from oracle import both

from flowloom.plans import flow_queries as q

SCHEMA = (
    "flow_id bigint, file_id bigint, first bigint, last bigint, srcip_hi bigint, srcip_lo bigint, dstip_hi bigint, dstip_lo bigint, srcport int, dstport int, "
    "proto smallint, flags smallint, bytes bigint, packets bigint, flows bigint, input bigint, output bigint"
)


def week():
    """Half a day of steady traffic and, within ten minutes of it each, a SYN flood and two bursts of large answers."""
    r, out = random.Random(3), []

    def add(window, src, dst, ports, proto, flags, size, packets, flows, at=None):
        first = (q.BEGIN + window * 600) * 1000 + (r.randrange(60_000) if at is None else at)
        out.append((len(out), 1, first, first + 50, 0, src, 0, dst, *ports, proto, flags, size, packets, flows, 0, 0))

    for window in range(72):
        for i in range(10):  # more flows in half a day than the flood, fewer in ten minutes; as many answers as questions
            for flags in (2, 18):
                add(window, 100 + i, 200 + i, (4000, 80), 6, flags, 4_000_000, 6_000, 6_000)
        for i in range(5):  # large answers, more of them in half a day, but slow
            add(window, 300 + i, 400 + i, (53, 4000), 17, 0, 3_000, 2, 50, at=i)
    for _ in range(150):
        add(5, 1, 2, (4000, 80), 6, 2, 40_000, 1_000, 1_000)
    for i in range(600):
        add(7, 11, 12, (53, 4000), 17, 0, 130_000, 100, 1)
        add(7, 13, 12, (53, 4000), 17, 0, 65_000 + 1300 * (i % 2), 50, 1)  # its second source changes size
        add(9, 13, 14, (53, 4000), 17, 0, 130_000 + r.randrange(9) * 1300, 100, 1)  # never of steady size
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("week"))
    spark.createDataFrame(week(), SCHEMA).repartition(3).write.parquet(f"{path}/parts")
    spark.read.parquet(f"{path}/parts").coalesce(1).toPandas().to_parquet(f"{path}/flow_records.parquet")
    return path


def found(spark, made, name):
    got, want = both(spark, made, q.queries()[name], q.oracle_sql()[name])
    assert got == want
    return q.queries()[name](spark, made).collect()


def test_windows_are_ten_minutes(spark, made):
    rows = found(spark, made, "window_topn")
    assert {x.window for x in rows} == set(range(72)) and max(x["rank"] for x in rows) == 5


def test_flood_within_ten_minutes(spark, made):
    assert [(x.window, x.srcip_lo, x.dstip_lo, x.flows, x.syn_packets, x.ack_packets) for x in found(spark, made, "detect_syn_flood")] == [(5, 1, 2, 150_000, 150_000, 0)]


def test_amplification_within_ten_minutes(spark, made):
    """The steady source is the first of its victim's list and counts 50; sizes that change all the time are no attack."""
    assert [(x.window, x.dstip_lo, x.reliability) for x in found(spark, made, "detect_amplification")] == [(7, 12, 50)]


def test_sizes_over_five_hundred_records(spark, made):
    rows = found(spark, made, "msg_size_stability")
    assert {(x.window, x.srcip_lo, x.dstip_lo) for x in rows if x.steady} == {(7, 11, 12)} and len(rows) == 72 * 5 + 3
