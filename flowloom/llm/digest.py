"""Percentiles per group from merging centroid digests, with certified rank errors.

A digest of a group is a short list of centroids (mean, weight, lo, hi): values sorted and
clustered so that a cluster spans at most one unit of k(q) = delta * (asin(2q - 1) / pi + 1/2)
of the quantiles q it covers, so clusters are small at both tails and at most ``delta`` in all.
Digests merge by sorting their centroids together and clustering again.  A task folds its rows in, some hundred thousand at a time, for all groups at
once with array operations.  It keeps the digests of the groups it has met while they have no more than
KEPT_ROWS centroids in all, and sends them on as partial ones beyond that; merging takes the centroids
sorted by group and sends on every group that is complete.  So a task's memory does not grow
with the number of groups.

What a digest says is an estimate, between a lower and an upper bound that hold however often digests were
merged, as every cluster knows its smallest and largest value.  ``certify`` counts, in a second
pass over the rows, how many values lie below the estimate and so how far its rank is off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.staging import ship

DELTA = 200
STEP_ROWS = 1 << 18
KEPT_ROWS = 1 << 19
#: Up to so many groups the estimates go to every task of the counting pass.
BROADCAST_GROUPS = 100_000


def rank_error(delta: int = DELTA, merges: int = 1) -> float:
    """Rank error of an estimate, as a share of the group, that is not to be exceeded after so many merges, one on top of the other.

    A unit of k is pi / (2 delta) of the ranks at the median, where clusters are largest.  Clusters of rows
    span one; each merge joins clusters that overlap in value, which adds a cluster's width.
    """
    return (merges + 1) * math.pi / (2 * delta)


def _codes(groups: pa.Table) -> np.ndarray:
    code = np.zeros(groups.num_rows, np.int64)
    for name in groups.column_names:
        c = pc.dictionary_encode(groups[name].combine_chunks(), null_encoding="encode")
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        code = np.unique(code * max(1, len(c.dictionary)) + c.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
    return code


def _recluster(t: pa.Table, groups: Sequence[str], delta: int) -> pa.Table:
    code = _codes(t.select(groups))
    mean, weight, lo, hi = (t[c].to_numpy(zero_copy_only=False) for c in ("mean", "weight", "lo", "hi"))
    order = np.lexsort((mean, code))
    code, mean, weight, lo, hi = code[order], mean[order], weight[order], lo[order], hi[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    sizes = np.diff(np.r_[starts, len(code)])
    total = np.repeat(np.add.reduceat(weight, starts), sizes)
    upto = np.cumsum(weight)
    before = np.repeat(np.r_[0, upto[starts[1:] - 1]], sizes)
    q = np.clip((upto - weight / 2 - before) / total, 0, 1)
    cluster = np.floor(delta * (np.arcsin(2 * q - 1) / math.pi + 0.5)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (cluster[1:] != cluster[:-1])])
    w = np.add.reduceat(weight, first)
    out = t.select(groups).take(pa.array(order[first]))
    for name, values in (
        ("mean", np.add.reduceat(mean * weight, first) / w),
        ("weight", w),
        ("lo", np.minimum.reduceat(lo, first)),
        ("hi", np.maximum.reduceat(hi, first)),
    ):
        out = out.append_column(name, pa.array(values))
    return out


def _folded(batches: Iterator[pa.RecordBatch], spread, groups: Sequence[str], delta: int, by_group: bool = False) -> Iterator[pa.RecordBatch]:
    """Digests of the groups from all batches; ``spread`` makes centroids of a table of rows.

    With ``by_group`` rows come sorted by group and each group comes out once; without, a
    group may come out several times.
    """
    kept, waiting, n = None, [], 0

    def fold() -> pa.Table | None:
        new = spread(pa.Table.from_batches(waiting))
        both = new if kept is None else pa.concat_tables([kept, new])
        return _recluster(both.combine_chunks(), groups, delta) if both.num_rows else kept

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
            if n >= STEP_ROWS:
                last, kept = waiting[-1], fold()
                waiting, n = [], 0
                if by_group and kept is not None:
                    open_one = _same_group(kept, last.slice(last.num_rows - 1), groups)
                    yield from kept.filter(pc.invert(open_one)).to_batches(max_chunksize=1 << 16)
                    kept = kept.filter(open_one)
                elif kept is not None and kept.num_rows > KEPT_ROWS:
                    yield from kept.to_batches(max_chunksize=1 << 16)
                    kept = None
    if waiting:
        kept = fold()
    if kept is not None:
        yield from kept.to_batches(max_chunksize=1 << 16)


def _same_group(t: pa.Table, row: pa.RecordBatch, groups: Sequence[str]) -> pa.ChunkedArray:
    same = pa.chunked_array([pa.array(np.ones(t.num_rows, bool))])
    for g in groups:
        value = row.column(row.schema.get_field_index(g))[0]
        same = pc.and_(same, pc.fill_null(pc.equal(t[g], value), False) if value.is_valid else pc.is_null(t[g]))
    return same


def _schema(rows: DataFrame, groups: Sequence[str], field: bool) -> T.StructType:
    out = T.StructType([rows.schema[g] for g in groups])
    if field:
        out = out.add("field", T.StringType())
    return out.add("mean", T.DoubleType()).add("weight", T.LongType()).add("lo", T.DoubleType()).add("hi", T.DoubleType())


def digests(rows: DataFrame, groups: Sequence[str], measures: Sequence[str], delta: int = DELTA) -> DataFrame:
    """groups, field, mean, weight, lo, hi: partial digests, one per task, group and measure.

    Null and not-a-number values count nothing; a null group is a group.  ``groups`` must not
    be named like the other columns of the result.  Merge before use.
    """
    ship(rows.sparkSession)
    names, ms = list(groups), list(measures)
    fields = pa.array(ms, pa.string())

    def spread(t: pa.Table) -> pa.Table:
        parts = []
        for i, m in enumerate(ms):
            v = pc.cast(t[m], pa.float64(), safe=False)
            keep = pc.fill_null(pc.invert(pc.is_nan(v)), False)
            own, v = t.select(names).filter(keep), v.filter(keep)
            own = own.append_column("field", fields.take(pa.array(np.full(len(v), i))))
            for name, x in (("mean", v), ("weight", pa.array(np.ones(len(v), np.int64))), ("lo", v), ("hi", v)):
                own = own.append_column(name, x)
            parts.append(own)
        return pa.concat_tables(parts)

    return rows.select(*names, *ms).mapInArrow(lambda bs: _folded(bs, spread, [*names, "field"], delta), _schema(rows, names, True))


def merge(parts: DataFrame, groups: Sequence[str], delta: int = DELTA) -> DataFrame:
    """Digests of tasks, days or finer groups as one digest per group.

    The shuffle moves at most delta rows per group and partial digest, and folding takes them a step
    at a time.
    """
    ship(parts.sparkSession)
    names = list(groups)
    own = parts.select(*names, "mean", "weight", "lo", "hi").repartition(*names).sortWithinPartitions(*names)
    return own.mapInArrow(lambda bs: _folded(bs, lambda t: t, names, delta, True), _schema(parts, names, False))


def quantile(merged: DataFrame, groups: Sequence[str], q: float | Sequence[float]) -> DataFrame:
    """groups, q, n, estimate, lower, upper: the q-quantile, and values that are not above and not below it.

    The quantile is the smallest value that at least the share q does not exceed.  The clusters whose
    largest values are at most x hold no more values than there are up to x, so x is ``upper`` where they
    hold as many as the rank; ``lower`` is the same from above.
    """
    whole = Window.partitionBy(*groups)
    upto = lambda *order: F.sum("weight").over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.select(
        *groups,
        "weight",
        "lo",
        "hi",
        F.sum("weight").over(whole).alias("n"),
        upto("mean", "lo", "hi", "weight").alias("upto"),
        upto("hi", "weight").alias("ended"),
        upto(F.desc("lo"), "weight").alias("begun"),
    )
    qs = [q] if isinstance(q, float) else list(q)
    asked = ranked.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    rank = F.greatest(F.ceil(F.col("q") * F.col("n")), F.lit(1))
    within = (F.col("upto") >= rank) & (F.col("upto") - F.col("weight") < rank)
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * (rank - F.col("upto") + F.col("weight") - 0.5) / F.col("weight")
    found = asked.groupBy(*groups, "q").agg(
        F.first("n").alias("n"),
        F.max(F.when(within, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(at))).alias("estimate"),
        F.max(F.when(F.col("begun") >= F.col("n") - rank + 1, F.col("lo"))).alias("lower"),
        F.min(F.when(F.col("ended") >= rank, F.col("hi"))).alias("upper"),
    )
    return found.withColumn("estimate", F.greatest(F.least("estimate", "upper"), "lower"))


def certify(rows: DataFrame, estimates: DataFrame, groups: Sequence[str], measures: Sequence[str], probe: Column | None = None) -> DataFrame:
    """estimates with below, upto, n_exact and rank_error: counted, not estimated.

    ``estimates`` (groups, field, q, estimate) and ``rows`` should be staged: the number of estimates
    decides whether they are sent to every task or, past BROADCAST_GROUPS, joined by a shuffle over
    groups and a salt.  Both ways give the same.  ``below`` and ``upto`` count values less than and not above the estimate;
    ``rank_error`` is the share by which the wanted rank lies outside them.  With ``probe``,
    an expression over the columns of estimates, below_probe counts the values less than it.
    """
    own = [*groups, "field", "q"]
    # a salt per row, as equal values may be most of a group; read from a staged table it is the same in every attempt
    salts, salt = 64, F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int")
    long_rows = rows.select(*groups, *measures, salt.alias("_row_salt")).select(
        *[F.col(g).alias(f"_{g}") for g in groups],
        "_row_salt",
        F.explode(F.array(*[F.struct(F.lit(m).alias("_field"), F.col(m).cast("double").alias("_v")) for m in measures])).alias("x"),
    ).select(*[f"_{g}" for g in groups], "_row_salt", "x.*").where("_v is not null and not isnan(_v)")
    asked = estimates.withColumn("_probe", probe.cast("double") if probe is not None else F.lit(None).cast("double"))
    match = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups] + [F.col("field") == F.col("_field")]
    if asked.count() <= BROADCAST_GROUPS:
        asked = F.broadcast(asked)
    else:
        asked = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        match.append(F.col("_salt") == F.col("_row_salt"))
    one = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    v, e = F.col("_v"), F.col("estimate")
    counted = long_rows.join(asked, match).groupBy(*own, "estimate").agg(
        F.count(F.lit(1)).alias("n_exact"), one(v < e).alias("below"), one(v <= e).alias("upto"), one(v < F.col("_probe")).alias("below_probe")
    )
    rank = F.greatest(F.ceil(F.col("q") * F.col("n_exact")), F.lit(1))
    off = F.greatest(F.col("below") + 1 - rank, rank - F.col("upto"), F.lit(0))
    out = counted.withColumn("rank_error", off / F.col("n_exact"))
    return out if probe is not None else out.drop("below_probe")
