"""Addresses as two bigints (hi, lo), an IPv4 address having hi = 0 and lo below 2^32."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.staging import ship

MIN_LONG = -(2**63)


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def halves(address: int) -> tuple[int, int]:
    return signed(address >> 64), signed(address & (2**64 - 1))


def parse(text: str) -> tuple[int, int, int | None]:
    """(address, width in bits, prefix length or None) of an address or network; shortened IPv4 networks such as 10.1/16 are allowed."""
    base, slash, length = text.partition("/")
    if ":" not in base and slash:
        base = ".".join((base.split(".") + ["0"] * 4)[:4])
    try:
        address = ipaddress.ip_address(base)
    except ValueError:
        raise ValueError(f"'{text}' is not an address") from None
    if not slash:
        return int(address), address.max_prefixlen, None
    if not length.isdigit() or int(length) > address.max_prefixlen:
        raise ValueError(f"'{length}' is not a prefix length of '{base}'")
    return int(address), address.max_prefixlen, int(length)


def is_v4(hi: Column, lo: Column) -> Column:
    return (hi == 0) & lo.between(0, 2**32 - 1)


def masked(hi: Column, lo: Column, v4_bits: int, v6_bits: int) -> tuple[Column, Column]:
    """The address with only its leading bits: v4_bits of IPv4 addresses, v6_bits of others."""
    v6 = (2**128 - 1) ^ (2 ** (128 - v6_bits) - 1)
    hi_mask, lo_mask = halves(v6)
    v4_mask = (2**32 - 1) ^ (2 ** (32 - v4_bits) - 1)
    short = is_v4(hi, lo)
    and_ = lambda c, m: c.bitwiseAND(F.lit(m).cast("long"))
    return F.when(short, hi).otherwise(and_(hi, hi_mask)), F.when(short, and_(lo, v4_mask)).otherwise(and_(lo, lo_mask))


def sort_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Signed bigints in the order of the unsigned 128-bit address."""
    flip = F.lit(MIN_LONG).cast("long")
    return hi.bitwiseXOR(flip), lo.bitwiseXOR(flip)


def minimum(hi: Column, lo: Column) -> Column:
    """Aggregate: the smallest address, as a struct (hi, lo)."""
    flip = F.lit(MIN_LONG).cast("long")
    low = F.min(F.struct(*[c.alias(n) for c, n in zip(sort_key(hi, lo), ("hi", "lo"))]))
    return F.struct(low["hi"].bitwiseXOR(flip).alias("hi"), low["lo"].bitwiseXOR(flip).alias("lo"))


def v4_text(lo: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(lo, by).bitwiseAND(F.lit(255))).cast("string") for by in (24, 16, 8, 0)])


def words_text(hi: Column, lo: Column) -> Column:
    """The four 32-bit words of an address, joined by colons."""
    low32 = F.lit(2**32 - 1)
    return F.concat_ws(":", *[F.shiftrightunsigned(c, by).bitwiseAND(low32).cast("string") for c in (hi, lo) for by in (32, 0)])


@F.pandas_udf(T.StringType())
def _v6_text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Halves must not be null: a series with nulls would come as floats and lose bits."""
    mask = 2**64 - 1
    show = socket.inet_ntop
    for hi, lo in parts:
        yield pd.Series([show(socket.AF_INET6, (((a & mask) << 64) | (b & mask)).to_bytes(16, "big")) for a, b in zip(hi.tolist(), lo.tolist())], dtype=object)


def text(hi: Column, lo: Column) -> Column:
    """The usual notation.  0.0.0.0 and 0.0.0.1 are taken for the IPv6 addresses :: and ::1, as C's test macro does."""
    ship(SparkSession.active())
    short = is_v4(hi, lo) & (lo > 1)
    zero = F.lit(0).cast("long")
    long = F.coalesce(~short, F.lit(False))
    v6 = _v6_text(F.when(long, F.coalesce(hi, zero)).otherwise(zero), F.when(long, F.coalesce(lo, zero)).otherwise(zero))
    return F.when(hi.isNull() | lo.isNull(), None).when(short, v4_text(lo)).otherwise(v6)
