"""Results per key where a few keys hold most rows.

Counts and sums per key combine before the shuffle, so no key is large after it.  Quantiles
do not combine like that.  For them, keys are told apart by their share of all rows:

* hot keys, each with at least ``hot_share`` of the rows, of which there can be at most
  ``1 / hot_share``: their ranks are found by refining histograms.  Each round splits the
  range known to hold the wanted value into ``bins`` equal parts and counts values per part;
  counts combine before the shuffle, so a round moves at most bins rows per key and task,
  and no task ever sees the values of a hot key.  A range shrinks by the factor ``bins`` a
  round, so 64-bit values need at most four rounds of 65,536 bins, usually two; where there may be
  more than a thousand hot keys, bins are 4,096 and rounds at most six.
* all others have less than that share by definition: they meet in one place per key, where sorts
  that may spill number the values of a measure, and the value of the rank wanted is kept.  No
  buffer holds the values of a key.

Both ways are exact over all of bigint.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.staging import stage

FEW_KEYS, MANY_KEYS = 65_536, 4_096
#: The least share a hot key may be asked to have, and so the most hot keys there are, 100,000: they are sent to every task.
LEAST_SHARE = 1e-5


def bins_for(hot_share: float) -> int:
    """Bins of a round, by how many keys may be hot."""
    return FEW_KEYS if hot_share >= 1e-3 else MANY_KEYS


def key_totals(rows: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """keys, n, and per measure n_x, sum_x, min_x, max_x; null keys are a group like any other."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        aggs += [F.count(m).alias(f"n_{m}"), F.try_sum(m).alias(f"sum_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    return rows.groupBy(*keys).agg(*aggs)


def hot_keys(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], hot_share: float) -> DataFrame:
    """``key_totals`` of the keys without nulls whose n is at least hot_share of all rows: no more than 1 / hot_share keys.

    The share is of all rows, those with null keys included.
    """
    if not LEAST_SHARE <= hot_share <= 1:
        raise ValueError(f"the share of a hot key must be from {LEAST_SHARE} to 1")
    whole = rows.agg(F.count(F.lit(1))).scalar()
    # a quotient, as it is rounded correctly: exactly the share is enough
    return key_totals(rows, keys, measures).dropna(subset=list(keys)).where(F.col("n") / whole >= F.lit(hot_share))


def select_ranks(rows: DataFrame, hot: DataFrame, keys: Sequence[str], measures: Sequence[str], quantile: float, bins: int = MANY_KEYS) -> DataFrame:
    """keys and q_x per measure: the smallest value that at least ``quantile`` of the key's values do not exceed.

    ``hot`` comes from ``hot_keys`` (staged, so its size is known and bounded) with n_x,
    min_x, max_x.  ``rows`` are re-read per round and should be staged as well.  A measure
    without values gives null.
    """
    slots = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("m"), F.col(f"n_{m}").alias("n"), F.col(f"min_{m}").cast("long").alias("lo"), F.col(f"max_{m}").cast("long").alias("hi"))
                for i, m in enumerate(measures)
            ]
        )
    ).alias("x")
    state = hot.select(*keys, slots).select(*keys, "x.*").where("n > 0")
    state = stage(state.select(*keys, "m", "lo", "hi", F.greatest(F.ceil(F.lit(quantile) * F.col("n")), F.lit(1)).cast("long").alias("rank")), "ranks")
    slim = rows.select(*keys, *[F.col(m).cast("long").alias(f"_v{i}") for i, m in enumerate(measures)])
    values = F.array(*[F.col(f"_v{i}") for i in range(len(measures))])
    # in decimals where a range is wider than bigint; a width is not, with two bins or more
    width = "cast(greatest(ceil((cast(hi as decimal(38,0)) - cast(lo as decimal(38,0)) + 1) / {b}), 1) as bigint)"
    place = "cast(coalesce(try_subtract(v, lo) div width, cast((cast(v as decimal(20,0)) - lo) div width as bigint)) as int)"
    for _ in range(math.ceil(64 / math.log2(bins)) + 1):
        if not state.where("hi > lo").head(1):
            break
        ranged = state.where("hi > lo").withColumn("width", F.expr(width.format(b=bins)))
        # a row per hot key with its open ranges, at most one per measure: there are at most 1 / hot_share, safe to send everywhere
        ranges = ranged.groupBy(*keys).agg(F.collect_list(F.struct("m", "lo", "hi", "width")).alias("ranges"))
        held = F.filter("ranges", lambda r: F.get("_values", r["m"]).between(r["lo"], r["hi"]))
        counted = (
            slim.withColumn("_values", values)
            .join(F.broadcast(ranges), list(keys))
            .select(*keys, "_values", F.explode(held).alias("r"))
            .select(*keys, "r.*", F.get("_values", "r.m").alias("v"))
            .groupBy(*keys, "m", F.expr(place).alias("bin"))
            .count()
            .join(F.broadcast(ranged), [*keys, "m"])
        )
        upto = Window.partitionBy(*keys, "m").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        found = (
            counted.withColumn("upto", F.sum("count").over(upto))
            .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("count") < F.col("rank")))
            .select(
                *keys,
                "m",
                F.expr("cast(lo + bin * cast(width as decimal(20,0)) as bigint)").alias("lo"),
                F.expr("cast(least(lo + (bin + 1) * cast(width as decimal(20,0)) - 1, cast(hi as decimal(38,0))) as bigint)").alias("hi"),
                (F.col("rank") - F.col("upto") + F.col("count")).alias("rank"),
            )
        )
        state = stage(found.unionByName(state.where("hi = lo")), "ranks")
    wide = [F.max(F.when(F.col("m") == i, F.col("lo"))).alias(f"q_{m}") for i, m in enumerate(measures)]
    return state.groupBy(*keys).agg(*wide)


def hot_key_results(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], hot_share: float, quantile: float = 0.5, bins: int | None = None) -> DataFrame:
    """keys, n, sum_x and q_x of the keys that hold at least ``hot_share`` of all rows.

    Rows with a null key count in the whole but are no result.  An empty table gives none.
    Sums past bigint come out null.
    """
    slim = rows.select(*keys, *measures)
    hot = stage(hot_keys(slim, keys, measures, hot_share), "hot")
    own = stage(slim.join(F.broadcast(hot.select(*keys)), list(keys), "left_semi"), "hotrows")
    ranks = select_ranks(own, hot, keys, measures, quantile, bins or bins_for(hot_share))
    return hot.join(F.broadcast(ranks), list(keys), "left").select(*keys, "n", *[f"sum_{m}" for m in measures], *[f"q_{m}" for m in measures])


def _ranked(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], quantile: float) -> DataFrame:
    """keys, n, sum_x and q_x of every key: one shuffle by key, then a sort per measure that numbers its values.

    All windows share the partitioning by key.  A rank is compared with the number of values
    of the measure, which nulls, sorted last, are not part of.
    """
    out = rows.repartition(*keys)
    whole = Window.partitionBy(*keys)
    for i, m in enumerate(measures):
        out = out.withColumn(f"_c{i}", F.count(m).over(whole))
    for i, m in enumerate(measures):
        out = out.withColumn(f"_r{i}", F.row_number().over(whole.orderBy(F.col(m).asc_nulls_last())))
    rank = lambda i: F.greatest(F.ceil(F.lit(quantile) * F.col(f"_c{i}")), F.lit(1))
    return out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.try_sum(m).alias(f"sum_{m}") for m in measures],
        *[F.max(F.when(F.col(f"_r{i}") == rank(i), F.col(m).cast("long"))).alias(f"q_{m}") for i, m in enumerate(measures)],
    )


def key_results(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], hot_share: float = 1e-4, quantile: float = 0.5, bins: int | None = None) -> DataFrame:
    """keys, n, sum_x and q_x of every key without nulls, hot or not; see the module."""
    slim = rows.select(*keys, *measures)
    hot = stage(hot_keys(slim, keys, measures, hot_share), "hot")
    names = F.broadcast(hot.select(*keys))
    own = stage(slim.join(names, list(keys), "left_semi"), "hotrows")
    ranks = select_ranks(own, hot, keys, measures, quantile, bins or bins_for(hot_share))
    hot_part = hot.join(F.broadcast(ranks), list(keys), "left")
    cold_part = _ranked(slim.dropna(subset=list(keys)).join(names, list(keys), "left_anti"), keys, measures, quantile)
    columns = [*keys, "n", *[f"sum_{m}" for m in measures], *[f"q_{m}" for m in measures]]
    return hot_part.select(*columns).unionByName(cold_part.select(*columns))
