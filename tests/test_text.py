import ipaddress
import random
import socket

import pytest
from fixture_flows import SCHEMA, records
from pyspark.sql import functions as F

from flowloom.functions import convert, ip
from flowloom.plans import render
from flowloom.plans.query import FlowQuery


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_addresses(spark):
    r = random.Random(0)
    texts = ["10.0.0.1", "255.255.255.255", "fd00::1", "2001:db8::", "::ffff:1.2.3.4", *(str(ipaddress.IPv6Address(r.getrandbits(128))) for _ in range(20))]
    df = spark.createDataFrame([(t, *ip.halves(ip.parse(t)[0])) for t in texts] + [("::", 0, 0), ("::1", 0, 1), (None, None, 5)], "t string, hi bigint, lo bigint")
    for x in df.select("t", ip.text(F.col("hi"), F.col("lo")).alias("x"), ip.words_text(F.col("hi"), F.col("lo")).alias("w")).collect():
        assert x.x == (x.t if x.t is None or ":" not in x.t else socket.inet_ntop(socket.AF_INET6, ipaddress.ip_address(x.t).packed))
        if x.t and ":" in x.t:
            n = int(ipaddress.ip_address(x.t))
            assert x.w == ":".join(str(n >> by & 0xFFFFFFFF) for by in (96, 64, 32, 0))


def test_masks(spark):
    for text, v4, v6 in [("10.1.2.3", 24, 64), ("10.1.2.3", 0, 0), ("10.1.2.3", 32, 128), ("fd01:2:3:4:5:6:7:8", 8, 70), ("fd01:2:3:4:5:6:7:8", 8, 33), ("fd01:2:3:4:5:6:7:8", 8, 0), ("fd01:2:3:4:ffff:6:7:8", 8, 65)]:
        address, width, _ = ip.parse(text)
        hi, lo = (F.lit(x).cast("long") for x in ip.halves(address))
        got = spark.range(1).select(*ip.masked(hi, lo, v4, v6)).first()
        length = v4 if width == 32 else v6
        assert tuple(got) == ip.halves(address >> (width - length) << (width - length))


@pytest.mark.parametrize(
    "value,metric,binary",
    [(0, "0.0  ", "0.0   "), (841, "841.0  ", "841.0   "), (1000, "1000.0  ", "1000.0   "), (1001, "1.0 k", "1001.0   "), (150000, "150.0 k", "146.5 Ki"), (0.25, "0.2  ", "0.2   "), (0.35, "0.3  ", "0.3   "), (2.9e6, "2.9 M", "2.8 Mi"), (1e30, "1000000.0 Y", "827180.6 Yi")],
)
def test_volumes(spark, value, metric, binary):
    assert convert.scaled(value, convert.METRIC, 1000) == metric and convert.scaled(value, convert.BINARY, 1024) == binary
    assert one(spark, convert.volume_text(F.lit(float(value)))) == metric


def test_scalars(spark):
    assert one(spark, convert.flags_text(F.lit(0b10110011))) == "C.UA..SF"
    assert convert.flags_number("CUASF") == 0b10110011 and convert.flags_number("x") == 255
    assert one(spark, convert.duration_text(F.lit(3_593_265).cast("long"))) == "00:59:53.265"
    assert one(spark, convert.duration_text(F.lit(360_000_000 + 1).cast("long"))) == "100:00:00.001"
    assert one(spark, convert.timestamp_text(F.lit(1445405280123).cast("long"))) == "2015-10-21 05:28:00.123"
    assert one(spark, convert.timestamp_text(F.lit(1445405280123).cast("long"), "Europe/Prague")) == "2015-10-21 07:28:00.123"
    assert [one(spark, convert.protocol_text(F.lit(n))) for n in (0, 6, 142, 143, 252, 255, 256)] == ["HOPOPT", "TCP", "ROHC", "Unassigned", "Unassigned", "Reserved", None]
    assert one(spark, convert.mac_text(F.lit(0x0123456789AB).cast("long"))) == "01:23:45:67:89:ab"
    assert convert.protocol_number("udp") == convert.protocol_number("17") == 17


@pytest.fixture(scope="module")
def flows(spark):
    return spark.createDataFrame(records(), SCHEMA)


def test_csv(flows):
    q = FlowQuery().statistic("proto").select("flows,bytes,duration,bps")
    got = list(render.lines(q.run(flows), q, render.style("csv")))
    assert got[0] == "proto,flows,bytes,duration,bps" and got[1].startswith("17,1302,1324856,") and len(got) == 4


def test_pretty(flows):
    q = FlowQuery().statistic("srcip").select("bytes,first")
    s = render.style(rich=True)
    got = list(render.lines(q.run(flows), q, s))
    assert got[0].split("    ")[0].strip() == "srcip (key)" and "flows {desc}" in got[0] and "bytes [sum]" in got[0] and got[0].endswith("first [min]")
    assert got[1].startswith("fd52:4efb:6b9d:c7d7::2 ") and "990.0  " in got[1] and got[1].endswith("2015-06-02 05:28:31.000")
    exact = list(render.lines(q.run(flows), q, render.style(ellipsize=False)))
    assert len(exact[1]) < len(got[1])
    keyed = FlowQuery().aggregate("proto").order_by("proto")
    assert render.header(keyed, True)[0] == "proto (key){asc}" and render.header(keyed, False)[0] == "proto"
    assert render.header(FlowQuery().order_by("bytes"), True)[:2] == ["bytes {desc}", "first"] and render.header(FlowQuery(), True)[0] == "first"


def test_undefined_values_and_ellipsis(spark):
    df = spark.createDataFrame([(0, 0, 0, 0)], "first bigint, last bigint, bytes bigint, packets bigint")
    q = FlowQuery().aggregate("bytes").select("bpp")
    assert list(render.lines(q.run(df), q, render.style("csv"))) == ["bytes,bpp", "0,NaN"]
    assert render._aligned(["x" * 50], ["srcip"], ("srcip",), [39]) == "x" * 36 + "..."


def test_summaries(flows):
    s = render.style("csv")
    assert list(render.processed_lines(10, 20, 30, 2.0, s)) == ["flows,packets,bytes,seconds,flows/second", "10,20,30,2.000000,5.0"]
    assert list(render.processed_lines(1500, 20, 30, 2.0, render.style()))[1] == "\t1.5 k flows, 20.0   packets, 30.0   bytes"


def test_basic_records(flows):
    some = flows.orderBy("first").limit(1)
    assert next(render.basic_records(some, render.style("csv"))).split(",")[2] == "6"
    text = next(render.basic_records(some, render.style()))
    assert "     10.123.234.1:23     " in text and text.startswith("2015-06-02 05:15:11.000    ")


def test_unknown_conversions():
    for own in ({"form": "xml"}, {"time": "raw"}, {"volume": "k"}, {"proto": "names"}):
        with pytest.raises(ValueError):
            render.style(**own)
