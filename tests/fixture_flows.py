"""Flow records of seventeen kinds whose sums are known; see FIXTURES.md."""

import ipaddress
import random

from flowloom.functions.ip import halves

# Source, destination, source port, protocol, bytes, packets, flows of each kind.
KINDS = [
    ("10.123.234.1", "10.11.22.33", 23, 6, 18000, 100, 4),
    ("10.245.11.241", "192.168.123.124", 53, 6, 24, 1, 1),
    ("10.245.11.241", "10.11.22.33", 80, 6, 190000, 2000, 10),
    ("172.2.1.199", "10.123.234.1", 23, 6, 18000, 50, 5),
    ("192.168.1.1", "192.168.0.1", 20, 6, 123, 2, 1),
    ("10.11.22.33", "192.168.123.124", 666, 6, 111222333, 111222, 200),
    ("10.10.11.11", "10.245.11.241", 20, 17, 1000, 2, 2),
    ("172.31.2.1", "192.168.1.1", 23, 17, 300400, 120, 120),
    ("10.123.234.1", "10.11.22.33", 443, 6, 22222, 333, 6),
    ("10.123.234.1", "10.11.22.33", 443, 17, 123456, 200, 190),
    ("172.31.2.1", "192.168.1.1", 0, 1, 30, 1, 1),
    ("172.31.2.1", "192.168.1.1", 0, 1, 30, 1, 1),
    ("172.31.2.1", "192.168.1.1", 0, 1, 30, 1, 1),
    ("172.31.2.1", "192.168.1.1", 0, 1, 30, 1, 1),
    ("fd69:abdc:93bc:d96c::1", "fd13:4efb:6b9d:c7d7::20", 20, 6, 666, 1, 1),
    ("fd3b:6ef4:84ed:26b5::3", "fd52:4efb:6b9d:c7d7::2", 666, 6, 101010, 1010, 10),
    ("fd52:4efb:6b9d:c7d7::2", "fd83:4efb:6b9d:c7d7::4", 23, 17, 900000, 1000, 990),
]
START = 1433222111000
SCHEMA = (
    "first bigint, last bigint, srcip_hi bigint, srcip_lo bigint, dstip_hi bigint, dstip_lo bigint, srcport int, dstport int, "
    "proto smallint, flags smallint, bytes bigint, packets bigint, flows bigint, input bigint, output bigint, received bigint"
)


def pair(text):
    return halves(int(ipaddress.ip_address(text)))


def records(seed=1):
    r = random.Random(seed)
    out = []
    for i, (src, dst, port, proto, size, packets, flows) in enumerate(KINDS):
        for j in range(flows):
            share = lambda whole: whole // flows + (whole % flows if j == 0 else 0)
            first = START + i * 50000 + j * 1000
            out.append((first, first + r.randrange(300000) + 10, *pair(src), *pair(dst), port, 0 if proto == 1 else 5000 + j, proto, 0, share(size), share(packets), 1, i % 5, i % 10, first))
    return out
