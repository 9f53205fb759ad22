"""The field catalog: every field a query can name, and what a query does with it by default."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LONG = -(2**63)
#: Addresses of one 32-bit word, the others zero.
V4_SPAN = 2**32


@dataclass(frozen=True)
class Field:
    """kind: time, volume, addr, mac, number, bits or calc. how: min, max, sum, or, calc."""

    name: str
    kind: str
    how: str
    descending: bool = False
    key: bool = True
    sortable: bool = True

    @property
    def columns(self) -> tuple[str, ...]:
        return (f"{self.name}_hi", f"{self.name}_lo") if self.kind == "addr" else (self.name,)


FIELDS = {
    f.name: f
    for f in (
        Field("first", "time", "min"),
        Field("last", "time", "max"),
        Field("received", "time", "max"),
        Field("bytes", "volume", "sum", True),
        Field("packets", "volume", "sum", True),
        Field("outbytes", "volume", "sum", True),
        Field("outpackets", "volume", "sum", True),
        Field("flows", "volume", "sum", True),
        Field("srcip", "addr", "min"),
        Field("dstip", "addr", "min"),
        Field("srcport", "number", "min"),
        Field("dstport", "number", "min"),
        Field("proto", "number", "min"),
        Field("flags", "bits", "or"),
        Field("input", "number", "min"),
        Field("output", "number", "min"),
        Field("insrcmac", "mac", "min", sortable=False),
        Field("outdstmac", "mac", "min", sortable=False),
        Field("duration", "calc", "calc", True),
        Field("bps", "calc", "calc", True, key=False),
        Field("pps", "calc", "calc", True, key=False),
        Field("bpp", "calc", "calc", True, key=False),
    )
}
ALIASES = {"pkts": "packets", "tcpflags": "flags", "srcaddr": "srcip", "dstaddr": "dstip", "ip": "srcip or dstip", "port": "srcport or dstport"}

LIST_FIELDS = ("first", "packets", "bytes", "srcip", "dstip", "srcport", "dstport", "proto", "flags")
AGGR_FIELDS = ("duration", "flows", "packets", "bytes", "flags", "bps", "pps", "bpp")

#: What each calculated field is calculated from.
NEEDS = {"duration": ("first", "last"), "bps": ("bytes", "first", "last"), "pps": ("packets", "first", "last"), "bpp": ("bytes", "packets")}


def field(name: str) -> Field:
    if name in ALIASES:
        raise ValueError(f"'{name}' is an alias, use the original name '{ALIASES[name]}'")
    if name not in FIELDS:
        raise ValueError(f"unknown field '{name}'; known are {', '.join(FIELDS)}")
    return FIELDS[name]


def zero(name: str) -> Column:
    """The column; an absent value is 0, as flow files cannot tell the two apart."""
    return F.coalesce(F.col(name), F.lit(0))


def calculated(name: str, get=zero, exact_bpp: bool = False) -> Column:
    """A calculated field from columns that ``get`` gives by name; null where it is undefined."""
    duration = get("last") - get("first")
    if name == "duration":
        return duration
    if name == "bpp":
        whole = F.try_divide(get("bytes"), get("packets"))
        return whole if exact_bpp else F.floor(whole).cast("double")
    if name == "bps":
        return F.try_divide(get("bytes") * F.lit(8000.0), duration)
    if name == "pps":
        return F.try_divide(get("packets") * F.lit(1000.0), duration)
    raise ValueError(f"'{name}' is not calculated")
