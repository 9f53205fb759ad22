import random

import pytest
from pyspark.sql import functions as F

from flowloom.plans.filterlang import FilterError, compile_filter, parse

# Filters that the language has to take as they are.
GIVEN = """src ip 192.168.2.15
not src ip 192.168.2.15
src net 192.168.0.0/16
src and dst net 192.168.0.0/16
ip 192.168.0.15 and not (src port gt 1024 and dst port gt 1024)
packets gt 10 and packets lt 31 and bytes gt 1400 and bytes lt 5000 and flags 18 and duration lt 5
src and dst ip 192.168.20.0/24 and src port lt 1024 and dst port 80 and proto 6 and flags 4 and bytes lt 25k and bpp lt 400
port 23
dst ip fd52:4efb:6b9d:c7d7::2
proto UDP and port >100
net 147.229.0.0/16""".splitlines()

CORPUS = [
    *GIVEN,
    "srcport 53 and proto UDP",
    "proto TCP && (flags S && not (flags AF)) || !(bpp > 1200)",
    "ip in [10.0.0.1 fd00::/8] or host 10/8",
    "exists srcip and in if 3 or out if = 4",
    "inet6 or ipv4 and any",
    "src ip != 192.168.0.7 or dst net <> fd00::/62",
    "ip != 10.0.0.1 and not net != 192.168.0.0/16",
    "src or dst ip != 192.168.8.8 and dst port in [443 0]",
    "flags isset SA or not flags isnset F",
    "first > 1970-01-01T00:03:20.5 and last <= 1970-01-01T00:15",
    "packets >= 5 && packets != 15 || bytes in [0, 5]",
    "pps > 10 or not bps <= 1.5k",
    "not (in if in [3] or out if != 4)",
]

COLUMNS = ["first", "last", "bytes", "packets", "flows", "srcip_hi", "srcip_lo", "dstip_hi", "dstip_lo", "srcport", "dstport", "proto", "flags", "input", "output"]


@pytest.fixture(scope="module")
def flows(spark):
    r = random.Random(8)
    address = lambda: r.choice([(0, 3232235520 + r.randrange(6000)), (0, 167772161), (-193004992274249769, 2), (-216172782113783808 + r.randrange(9), r.randrange(-5, 5)), (None, 3), (0, None), (0, 0)])
    small = lambda *xs: r.choice([None, 0, *xs])
    rows = []
    for _ in range(1500):
        (a, b), (c, d), t = address(), address(), r.randrange(10**6)
        rows.append((small(t), small(t + r.randrange(-3, 9000)), small(r.randrange(60000)), small(1, 5, 15, 40), 1, a, b, c, d, small(23, 53, 443, 2000), small(80, 443, 8080, 9999), small(1, 6, 17), small(2, 3, 4, 18, 19, 27, 255), small(3, 4), small(3, 4)))
    return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in COLUMNS)).cache()


@pytest.mark.parametrize("text", CORPUS)
def test_a_filter_and_its_negation_part_the_records(flows, text):
    held, failed = flows.where(compile_filter(text)).count(), flows.where(compile_filter(f"not ({text})")).count()
    assert held + failed == flows.count()
    # with zeros in place of absent values nothing changes
    assert flows.na.fill(0).where(compile_filter(text)).count() == held or "exists" in text


def test_meaning(flows):
    zero = flows.na.fill(0)
    count = lambda text: flows.where(compile_filter(text)).count()
    assert count("src net 192.168.0.0/20") == zero.where("srcip_hi = 0 and srcip_lo between 3232235520 and 3232239615").count() > 0
    assert count("dst net fd00::/62") == zero.where("dstip_hi between -216172782113783808 and -216172782113783805").count() > 0
    assert count("src ip fd00::3") == zero.where("srcip_hi = -216172782113783808 and srcip_lo = 3").count()
    assert count("src net fd00::/65") == zero.where("srcip_hi = -216172782113783808 and srcip_lo >= 0").count() > 0
    assert count("src net ::/0") == flows.count() and count("") == flows.count()
    assert count("flags 18") == zero.where("(flags & 18) = 18").count() > 0
    assert count("not flags AF") == zero.where("(flags & 17) = 0").count() > 0
    assert count("not (flags AF)") == zero.where("(flags & 17) <> 17").count()
    assert count("bytes lt 25k") == zero.where("bytes < 25000").count()
    assert count("bpp lt 400") == zero.where("packets > 0 and bytes div packets < 400").count()
    assert count("duration >= 5") == zero.where("last - first >= 5").count()
    assert count("not dst port in [80 443]") == zero.where("dstport not in (80, 443)").count()
    assert count("proto icmp or proto in [udp 47]") == zero.where("proto in (1, 17, 47)").count()
    unequal = zero.where("not (srcip_hi = 0 and srcip_lo = 167772161)").count()
    assert count("src ip != 10.0.0.1") == count("not src ip 10.0.0.1") == unequal < flows.count()
    assert count("src net != 192.168.0.0/20") == flows.count() - count("src net 192.168.0.0/20")
    assert count("ip != 10.0.0.1") == flows.count() - count("src and dst ip 10.0.0.1")  # either side differs
    assert count("src and dst ip != 10.0.0.1") == flows.count() - count("ip 10.0.0.1")
    assert count("first >= 1970-01-01T00:05") == zero.where("first >= 300000").count() > 0
    assert count("flags isnset AF") == count("not flags AF") and count("not flags isset AF") == count("not (flags AF)")
    assert count("not port 0") == zero.where("srcport <> 0 and dstport <> 0").count()


@pytest.mark.parametrize("text", ["ip", "ip 1.2.3", "src port", "port in []", "port in [80", "proto nosuch", "flags Q", "bytes >", "(proto 6", "proto 6)", "proto 6 proto 7", "and", "nosuch 5", "src bytes 5", "bytes lt 5x", "port 80 ; 81", "src ip 1.2.3.4/33", "srcip", "src ip > 10.0.0.1", "ip <= 10.0.0.1", "dst net lt 10/8", "flags > 2", "bps in [5]", "first > 2024-13-01", "src ip !="])
def test_errors(text):
    with pytest.raises(FilterError):
        parse(text)


def test_conditions_reach_the_scan(spark, tmp_path, flows):
    flows.where("srcip_hi is not null").write.parquet(str(tmp_path / "x"))
    rows = spark.read.parquet(str(tmp_path / "x"))
    plan = lambda text: rows.where(compile_filter(text)).select(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    pushed = lambda text: next(line for line in plan(text).splitlines() if "PushedFilters" in line).split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(srcip_lo,167772160)" in pushed("src net 10.0.0.0/8 and flags S")
    assert "EqualTo(dstport,80)" in pushed("not (not dst port 80 or bytes lt 5)")
    assert "Or(In(dstport, [" in pushed("dst port in [80 443] or proto 17 and packets gt 10")
    assert "IsNull(bytes)" in pushed("bytes lt 25k or dst port 80")
