import pytest
from fixture_flows import SCHEMA, START, pair, records

from flowloom.plans import summary
from flowloom.plans.query import FlowQuery, Spec


@pytest.fixture(scope="module")
def flows(spark):
    return spark.createDataFrame(records(), SCHEMA).repartition(5).cache()


def rows(df):
    return [tuple(x) for x in df.collect()]


def test_listing(flows):
    assert flows.count() == FlowQuery().run(flows).count() == 1544
    assert FlowQuery().where("port 23").run(flows).count() == 1119
    assert FlowQuery().where("port 23").limit(50).run(flows).count() == 50
    assert FlowQuery().run(flows).columns == ["first", "packets", "bytes", "srcip_hi", "srcip_lo", "dstip_hi", "dstip_lo", "srcport", "dstport", "proto", "flags"]


def test_goldens_by_protocol(flows):
    q = FlowQuery().statistic("proto").select("flows,packets,bytes,first")
    assert rows(q.run(flows)) == [(17, 1302, 1322, 1324856, 1433222411000), (6, 238, 114719, 111572378, START), (1, 4, 4, 120, 1433222611000)]


def test_goldens_by_source(flows):
    got = {r[:2]: r[2:] for r in rows(FlowQuery().aggregate("srcip").select("flows,packets,bytes,first").run(flows))}
    assert len(got) == 10
    assert got[pair("10.123.234.1")] == (200, 633, 163678, START)
    assert got[pair("172.31.2.1")] == (124, 124, 300520, 1433222461000)
    assert got[pair("fd52:4efb:6b9d:c7d7::2")] == (990, 1000, 900000, 1433222911000)


def test_goldens_of_filters(flows):
    assert FlowQuery().aggregate("srcport,srcip,proto").run(flows).count() == 14
    by_port = rows(FlowQuery().where("dst ip fd52:4efb:6b9d:c7d7::2").aggregate("dstport").select("flows,packets,bytes").run(flows))
    assert len(by_port) == 10 and {r[1] for r in by_port} == {1} and sum(r[2] for r in by_port) == 1010 and sum(r[3] for r in by_port) == 101010
    top = rows(FlowQuery().where("proto UDP and port >100").statistic("srcip").select("flows").run(flows))
    assert [(r[:2], r[2]) for r in top] == [(pair(a), n) for a, n in (("fd52:4efb:6b9d:c7d7::2", 990), ("10.123.234.1", 190), ("172.31.2.1", 120), ("10.10.11.11", 2))]


def test_order_of_options_and_columns(flows):
    q = FlowQuery().limit(3).statistic("srcip,proto#bytes#asc")
    assert (q.top, q.order, q.descending) == (10, "bytes", False)
    assert q.limit(3).top == 3 and q.order_by("flows").descending
    assert q.select("flows,srcip,bytes").shown == ("srcip", "proto", "bytes", "flows")
    assert FlowQuery().aggregate("srcip").select("").columns == ("srcip_hi", "srcip_lo")
    same = lambda q: rows(q.run(flows))
    assert same(FlowQuery().statistic("srcip,proto#bytes")) == same(FlowQuery().aggregate("srcip,proto").order_by("bytes#desc").limit(10))
    assert FlowQuery().aggregate("srcip/24,srcip/8").keys == (Spec("srcip", 24, 128),)


def test_alignment(flows):
    nets = {r[:2] for r in rows(FlowQuery().aggregate("srcip/8/32").select("flows").run(flows))}
    assert nets == {pair(a) for a in ("10.0.0.0", "172.0.0.0", "192.0.0.0", "fd52:4efb::", "fd3b:6ef4::", "fd69:abdc::")}
    assert {r[0] for r in rows(FlowQuery().aggregate("first/20").select("").run(flows))} == {r[0] >> 20 << 20 for r in records()}
    assert {r[:2] for r in rows(FlowQuery().aggregate("srcip/0/128").select("").run(flows)) if r[0] == 0} == {(0, 0)}


def test_smallest_address_and_unsigned_order(flows):
    smallest = rows(FlowQuery().aggregate("proto").select("srcip").run(flows))
    assert dict((r[0], r[1:]) for r in smallest)[17] == pair("10.10.11.11")
    order = [r[:2] for r in rows(FlowQuery().aggregate("srcip").order_by("srcip#desc").select("").run(flows))]
    assert order[0] == pair("fd69:abdc:93bc:d96c::1") and order[-1] == pair("10.10.11.11")


def test_calculated_fields(spark):
    df = spark.createDataFrame([(0, 2000, 10, 1000, 3), (1000, 5000, 10, 1000, 1), (7, 7, 11, 5, 0)], "first bigint, last bigint, srcport int, bytes bigint, packets bigint")
    got = {r[0]: r[1:] for r in rows(FlowQuery().aggregate("srcport").select("duration,bps,pps,bpp").run(df))}
    assert got == {10: (5000, 3200.0, 0.8, 500.0), 11: (0, None, None, None)}


def test_absent_values_are_zero(spark):
    df = spark.createDataFrame([(None, 5), (0, None), (1, 1)], "srcport int, bytes bigint")
    assert sorted(rows(FlowQuery().aggregate("srcport").select("bytes").run(df))) == [(0, 5), (1, 1)]


@pytest.mark.parametrize(
    "build",
    [
        lambda q: q.aggregate(""),
        lambda q: q.aggregate("bps"),
        lambda q: q.aggregate("pkts"),
        lambda q: q.aggregate("nosuch"),
        lambda q: q.aggregate("srcip/33"),
        lambda q: q.aggregate("srcip/"),
        lambda q: q.aggregate("srcip/24/129"),
        lambda q: q.order_by("bytes#up"),
        lambda q: q.limit(-1),
        lambda q: q.where("port"),
        lambda q: q.aggregate("first,last,received,bytes,packets,flows,srcip,dstip,srcport,dstport,proto"),
    ],
)
def test_invalid(build):
    with pytest.raises(ValueError):
        build(FlowQuery())


def test_totals_agree(flows):
    totals = summary.processed(FlowQuery().where("proto TCP").matching(flows)).first()
    by_key = FlowQuery().where("proto TCP").aggregate("srcip,dstport").select("flows,packets,bytes").run(flows).groupBy().sum("flows", "packets", "bytes").first()
    assert tuple(totals) == tuple(by_key) == (238, 114719, 111572378)
    meta = {r.field: r for r in summary.metadata_of_records(flows).collect()}
    assert (meta["flows"].total, meta["flows"].tcp, meta["flows"].udp, meta["flows"].icmp, meta["flows"].other) == (1544, 238, 1302, 4, 0)


def test_plans(flows):
    plan = lambda q: q.run(flows)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(FlowQuery().order_by("bytes").limit(5))
    assert "TakeOrderedAndProject" in plan(FlowQuery().statistic("srcip"))
    assert "partial_sum" in plan(FlowQuery().statistic("srcip"))
