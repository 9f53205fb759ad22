"""Distinct counts with log-log registers, as a table of registers.

A sketch of a group is up to 2^p rows (group, register, rank): a value's hash chooses the
register by its first p bits, and the register keeps the largest number of leading zeros,
plus one, of the remaining bits.  Keeping the largest is an ordinary max that combines before
the shuffle, so a hot group sends at most 2^p rows per task, and repeated values change
nothing.  Sketches of days or partitions merge by the same max.  Groups with few values have
few rows, so millions of small groups cost what their values cost.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = 12


def standard_error(p: int = P) -> float:
    """Relative standard error of an estimate from 2^p registers."""
    return 1.04 / math.sqrt(2**p)


def _rank(h: Column, p: int) -> Column:
    """Leading zeros of the 64 - p bits after the first p, plus one."""
    rest = h.bitwiseAND(F.lit((1 << (64 - p)) - 1).cast("long"))
    filled = rest
    for by in (1, 2, 4, 8, 16, 32):  # every bit below the highest one set, whose count is its position
        filled = filled.bitwiseOR(F.shiftrightunsigned(filled, by))
    return (F.lit(64 - p + 1) - F.bit_count(filled)).cast("byte")


def registers(rows: DataFrame, groups: Sequence[str], values: Sequence[str], p: int = P) -> DataFrame:
    """groups, register, rank.  Rows with a null in ``values`` count nothing; a null group is a group."""
    h = rows.dropna(subset=list(values)).select(*groups, F.xxhash64(*values).alias("_h"))
    smeared = h.select(*groups, F.shiftrightunsigned("_h", 64 - p).cast("int").alias("register"), _rank(F.col("_h"), p).alias("rank"))
    return smeared.groupBy(*groups, "register").agg(F.max("rank").alias("rank"))


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of finer groups, days or partitions, as sketches of ``groups``."""
    return sketches.groupBy(*groups, "register").agg(F.max("rank").alias("rank"))


def _sigma(x: float) -> float:
    """x + sum over k >= 1 of x^(2^k) 2^(k-1): what a share x of empty registers says; no end for x = 1, which no group has."""
    total, power, weight = x, x * x, 1.0
    while x < 1 and total + power * weight > total:
        total, power, weight = total + power * weight, power * power, 2 * weight
    return total


def _tau(x: float) -> float:
    """(1 - x - sum over k >= 1 of (1 - x^(2^-k))^2 2^-k) / 3: what a share 1 - x of registers at the largest rank says."""
    return (1 - x - sum((1 - x ** 2.0**-k) ** 2 * 2.0**-k for k in range(1, 60))) / 3


def _table(values: list[float], at: Column) -> Column:
    """values[at], from a constant array; made of one literal, as thousands of them would burden the planner."""
    return F.get(F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>"), at.cast("int"))


def estimate(sketches: DataFrame, groups: Sequence[str], p: int = P) -> DataFrame:
    """groups, distinct_count (double) and standard_error (double, relative).

    Ertl's improved estimator over how often each rank occurs: one formula from a single value to
    billions, unbiased throughout, without a switch between ranges.
    """
    m, last = 2**p, 64 - p + 1
    top = (F.col("rank") == last).cast("int")
    found = sketches.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_used"), F.sum(F.when(F.col("rank") < last, F.pow(F.lit(2.0), -F.col("rank"))).otherwise(0.0)).alias("_sum"), F.sum(top).alias("_top")
    )
    # by the number of registers: the terms of empty ones, and of those at the last rank
    z = _table([m * _sigma(i / m) for i in range(m + 1)], F.lit(m) - F.col("_used")) + F.col("_sum")
    z = z + F.when(F.col("_top") > 0, _table([m * _tau(1 - i / m) * 2.0 ** -(last - 1) for i in range(m + 1)], F.col("_top"))).otherwise(0.0)
    value = F.lit(m * m / (2 * math.log(2))) / z
    return found.select(*groups, value.alias("distinct_count"), F.lit(standard_error(p)).alias("standard_error"))
