"""Values as text: the conversions that printed results use."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.staging import ship

# Names of protocol numbers 0 to 142; 143 to 252 are unassigned.
PROTOCOLS = [
    "HOPOPT", "ICMP", "IGMP", "GGP", "IPv4", "ST", "TCP", "CBT", "EGP", "IGP",
    "BBN-RCC-MON", "NVP-II", "PUP", "ARGUS", "EMCON", "XNET", "CHAOS", "UDP", "MUX", "DCN-MEAS",
    "HMP", "PRM", "XNS-IDP", "TRUNK-1", "TRUNK-2", "LEAF-1", "LEAF-2", "RDP", "IRTP", "ISO-TP4",
    "NETBLT", "MFE-NSP", "MERIT-INP", "DCCP", "3PC", "IDPR", "XTP", "DDP", "IDPR-CMTP", "TP++",
    "IL", "IPv6", "SDRP", "IPv6-Route", "IPv6-Frag", "IDRP", "RSVP", "GRE", "DSR", "BNA",
    "ESP", "AH", "I-NLSP", "SWIPE", "NARP", "MOBILE", "TLSP", "SKIP", "IPv6-ICMP", "IPv6-NoNxt",
    "IPv6-Opts", "any host internal protocol", "CFTP", "any local network", "SAT-EXPAK", "KRYPTOLAN", "RVD", "IPPC", "any distributed file system", "SAT-MON",
    "VISA", "IPCV", "CPNX", "CPHB", "WSN", "PVP", "BR-SAT-MON", "SUN-ND", "WB-MON", "WB-EXPAK",
    "ISO-IP", "VMTP", "SECURE-VMTP", "VINES", "TTP/IPTM", "NSFNET-IGP", "DGP", "TCF", "EIGRP", "OSPFIGP",
    "Sprite-RPC", "LARP", "MTP", "AX.25", "IPIP", "MICP", "SCC-SP", "ETHERIP", "ENCAP", "any private encryption",
    "GMTP", "IFMP", "PNNI", "PIM", "ARIS", "SCPS", "QNX", "A/N", "IPComp", "SNP",
    "Compaq-Peer", "IPX-in-IP", "VRRP", "PGM", "any 0-hop protocol", "L2TP", "DDX", "IATP", "STP", "SRP",
    "UTI", "SMP", "SM", "PTP", "ISIS over IPv4", "FIRE", "CRTP", "CRUDP", "SSCOPMCE", "IPLT",
    "SPS", "PIPE", "SCTP", "FC", "RSVP-E2E-IGNORE", "Mobility Header", "UDPLite", "MPLS-in-IP", "manet", "HIP",
    "Shim6", "WESP", "ROHC",
]
# The last three protocol numbers, and the word for those without a name.
LAST_PROTOCOLS = {253: "experimentation and testing", 254: "experimentation and testing", 255: "Reserved"}
UNASSIGNED = "Unassigned"

# The letters of the TCP flags, highest bit first.
FLAG_LETTERS = "CEUAPRSF"

# Unit prefixes.
METRIC = [" ", "k", "M", "G", "T", "P", "E", "Z", "Y"]
BINARY = ["  ", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi", "Yi"]


def protocol_names() -> list[str]:
    return [PROTOCOLS[n] if n < len(PROTOCOLS) else LAST_PROTOCOLS.get(n, UNASSIGNED) for n in range(256)]


def protocol_text(proto: Column) -> Column:
    """The name of a protocol number; numbers beyond a byte have none.  A lookup by position in a constant array."""
    names = F.array(*map(F.lit, protocol_names()))
    n = proto.cast("int")
    return F.when(n.between(0, 255), F.element_at(names, F.when(n.between(0, 255), n).otherwise(0) + 1))


def protocol_number(text: str) -> int:
    if text.isdigit() and int(text) < 256:
        return int(text)
    names = [n.lower() for n in PROTOCOLS]
    other = {"icmp6": 58, "icmpv6": 58}
    if text.lower() in other:
        return other[text.lower()]
    if text.lower() not in names:
        raise ValueError(f"unknown protocol '{text}'")
    return names.index(text.lower())


def flags_text(flags: Column) -> Column:
    """Eight characters, a dot where a bit is not set."""
    bit = lambda i: F.when(flags.bitwiseAND(F.lit(1 << (7 - i))) != 0, FLAG_LETTERS[i]).otherwise(".")
    return F.when(flags.isNotNull(), F.concat(*[bit(i) for i in range(8)]))


def flags_number(letters: str) -> int:
    bits = 0
    for x in letters.upper():
        if x == "X":
            bits |= 0xFF
        elif x in FLAG_LETTERS:
            bits |= 1 << (7 - FLAG_LETTERS.index(x))
        else:
            raise ValueError(f"'{letters}' are not TCP flags")
    return bits


def duration_text(ms: Column) -> Column:
    """HH:MM:SS.mmm with as many hours as it takes."""
    div, sign = (lambda c, by: F.call_function("div", c, F.lit(by).cast("long"))), F.when(ms < 0, "-").otherwise("")
    size = F.abs(ms)
    part = lambda c, n: F.lpad(c.cast("string"), n, "0")
    hours = div(size, 3_600_000)
    shown = F.when(hours > 99, hours.cast("string")).otherwise(part(hours, 2))
    return F.concat(sign, shown, F.lit(":"), part(div(size, 60_000) % 60, 2), F.lit(":"), part(div(size, 1000) % 60, 2), F.lit("."), part(size % 1000, 3))


def timestamp_text(ms: Column, zone: str = "UTC") -> Column:
    """YYYY-MM-DD HH:MM:SS.mmm in the zone, whatever the session's own."""
    utc = F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "yyyy-MM-dd HH:mm:ss.SSS")


def scaled(value: float, units: list[str], by: int) -> str:
    """One decimal and a unit; divided while larger than ``by``, so exactly ``by`` stays."""
    x, i = float(value), 0
    while x > by and i < len(units) - 1:
        x, i = x / by, i + 1
    return f"{x:.1f} {units[i]}"


def _volume_udf(units: list[str], by: int):
    @F.pandas_udf(T.StringType())
    def convert(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([None if pd.isna(v) else scaled(v, units, by) for v in s])

    return convert


def volume_text(value: Column, how: str = "metric-prefix") -> Column:
    """metric-prefix, binary-prefix or none.

    The prefixes need C's rounding of the exact binary value, which Python has and the
    JVM's formatter has not; hence an Arrow UDF, meant for results that are printed.
    """
    if how == "none":
        return value.cast("string")
    ship(SparkSession.active())
    units, by = {"metric-prefix": (METRIC, 1000), "binary-prefix": (BINARY, 1024)}[how]
    return _volume_udf(units, by)(value.cast("double"))


@F.pandas_udf(T.StringType())
def _one_decimal(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield pd.Series([None if pd.isna(v) else f"{v:.1f}" for v in s], dtype=object)


def decimal_text(value: Column) -> Column:
    """A double with one decimal, rounded as C does."""
    ship(SparkSession.active())
    return _one_decimal(value)


def mac_text(mac: Column) -> Column:
    """Six bytes of a bigint as %02x joined by colons."""
    joined = F.concat_ws(":", *[F.lower(F.lpad(F.hex(F.shiftrightunsigned(mac, by).bitwiseAND(F.lit(255))), 2, "0")) for by in (40, 32, 24, 16, 8, 0)])
    return F.when(mac.isNotNull(), joined)
