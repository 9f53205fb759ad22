"""The driver's queries of the operators over flow records, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import digest, lossy, registers, topn
from flowloom.sources.tables import day, distinct_flows, flow_records, present
from flowloom.staging import stage

SRC, DST = ("srcip_hi", "srcip_lo"), ("dstip_hi", "dstip_lo")
SUPPORT, ERROR = 0.01, 0.001


# ---- frequent values


def _values(spark: SparkSession, sf: str) -> DataFrame:
    rows = distinct_flows(flow_records(spark, sf), *SRC, *DST, "dstport")
    halves = lambda x: [F.when(present(x), F.col(f"{x}_{h}")).alias(f"{x}_{h}") for h in ("hi", "lo")]
    return rows.select(*halves("srcip"), *halves("dstip"), "dstport")


FIELDS = {"srcip": SRC, "dstip": DST, "dstport": ("dstport",)}


def _each_value(values: DataFrame) -> DataFrame:
    """field, value_hi, value_lo: a row per record and field."""
    value = lambda name, cs: F.struct(
        F.lit(name).alias("field"), (F.col(cs[0]) if len(cs) > 1 else F.lit(0)).cast("long").alias("value_hi"), F.col(cs[-1]).cast("long").alias("value_lo")
    )
    return values.select(F.explode(F.array(*[value(n, cs) for n, cs in FIELDS.items()])).alias("x")).select("x.*")


def p2_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return lossy.frequent(lossy.summaries(_values(spark, sf), FIELDS, ERROR), SUPPORT)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Frequent values by their guaranteed intervals; where an interval holds the limit, counted exactly.

    Candidates are at most 1 / (SUPPORT - ERROR) per field and so may be sent to every task.
    """
    values = _values(spark, sf)
    candidates = stage(lossy.frequent(lossy.summaries(values, FIELDS, ERROR), SUPPORT), "frequent")
    reaches = lambda c: F.col(c) / F.col("total") >= F.lit(SUPPORT)
    sure, open_ones = candidates.where(reaches("count_low")), candidates.where(~reaches("count_low"))
    if not open_ones.head(1):
        return sure.select("field", "value_hi", "value_lo")
    counted = _each_value(values).join(F.broadcast(open_ones), ["field", "value_hi", "value_lo"]).groupBy("field", "value_hi", "value_lo", "total").count()
    return sure.select("field", "value_hi", "value_lo").unionByName(counted.where(reaches("count")).select("field", "value_hi", "value_lo"))


def p2_intervals_hold(spark: SparkSession, sf: str) -> DataFrame:
    """Every frequent value with its exact count, and whether the guaranteed interval holds it."""
    values = _values(spark, sf)
    candidates = stage(lossy.frequent(lossy.summaries(values, FIELDS, ERROR), SUPPORT), "frequent")
    counted = _each_value(values).join(F.broadcast(candidates), ["field", "value_hi", "value_lo"]).groupBy("field", "value_hi", "value_lo", "total", "count_low", "count_high").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") / F.col("total") >= F.lit(SUPPORT)).select("field", "value_hi", "value_lo", "n", F.col("n").between(F.col("count_low"), F.col("count_high")).alias("holds"))


# ---- distinct counts


def _with_day(spark: SparkSession, sf: str) -> DataFrame:
    return flow_records(spark, sf).withColumn("day", day())


def _registers_by_field(rows: DataFrame, groups: list[str], addresses: tuple[str, ...] = ("srcip", "dstip")) -> DataFrame:
    """Registers of dstport and of the addresses named.  Copies of a record change no register, so they need no removing."""
    return registers.registers(_identifiers(rows, groups, addresses), [*groups, "field"], ["a", "b"])


def _identifiers(rows: DataFrame, groups: list[str], addresses: tuple[str, ...] = ("srcip", "dstip")) -> DataFrame:
    """groups, field, a, b: the values that are counted; a is null where there is none."""
    values = F.array(
        *[F.struct(F.lit(x).alias("field"), F.when(present(x), F.col(f"{x}_hi")).alias("a"), F.col(f"{x}_lo").alias("b")) for x in addresses],
        F.struct(F.lit("dstport").alias("field"), F.col("dstport").cast("long").alias("a"), F.lit(0).cast("long").alias("b")),
    )
    return rows.select(*groups, F.explode(values).alias("x")).select(*groups, "x.field", "x.a", "x.b")


COMBINED = ["day", "exporter_id", "proto"]
CHOICES = [[c for i, c in enumerate(COMBINED) if bits >> i & 1] for bits in range(2 ** len(COMBINED))]


def _merged(sketches: DataFrame, always: list[str]) -> DataFrame:
    """Estimates of ``always`` with each of the eight choices of COMBINED, by merging the registers of the finest groups.

    ``level`` has the bits 16, 8 and 4 (of ``grouping_id``) for day, exporter_id and proto where they are merged
    over; a null without its bit is the group of records that have none.
    """
    last = [*always, "field", "register"]
    sets = sketches.groupingSets([[*own, *last] for own in CHOICES], *COMBINED, *last).agg(F.max("rank").alias("rank"), F.grouping_id().alias("level"))
    level = F.shiftright("level", len(always)).alias("level")
    return registers.estimate(sets.select(*COMBINED, *last, "rank", level), [*COMBINED, *always, "field", "level"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_per_srcip(spark, sf).where("day is not null and distinct_count >= 40").select("day", *SRC, "field")


def p4_per_srcip(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct dstip and dstport per day and present srcip; records without a day are a group of each srcip.

    A srcip has one srcip, so that field is left out.
    """
    keys = ["day", *SRC]
    rows = _with_day(spark, sf).where(present("srcip"))
    return registers.estimate(_registers_by_field(rows, keys, ("dstip",)), [*keys, "field"])


def p4_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct srcip, dstip and dstport per day, exporter, protocol and every combination of them, down to all records."""
    return _merged(_registers_by_field(_with_day(spark, sf), COMBINED), [])


def p4_srcip_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """As p4_per_srcip, with srcip alone and with every combination of day, exporter and protocol."""
    rows = _with_day(spark, sf).where(present("srcip"))
    return _merged(_registers_by_field(rows, [*COMBINED, *SRC], ("dstip",)), SRC)


def _close(estimated: str, exact: str) -> Column:
    """Within four standard errors or, where that is more, two values: small counts are off by whole values that share a register."""
    return F.abs(F.col(estimated) - F.col(exact)) <= F.greatest(F.lit(2.0), 4 * F.col("standard_error") * F.col(exact))


def p4_counts_hold(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of p4_combinations against exact ones, which are for this comparison only."""
    values = _identifiers(_with_day(spark, sf), COMBINED).where("a is not null and b is not null").distinct()
    sets = values.groupingSets([[*own, "field"] for own in CHOICES], *COMBINED, "field").agg(F.count_distinct("a", "b").alias("n"), F.shiftleft(F.grouping_id(), 1).alias("level"))
    found = p4_combinations(spark, sf).withColumnsRenamed({c: f"_{c}" for c in [*COMBINED, "field", "level"]})
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*COMBINED, "field", "level"]]
    holds = F.coalesce(_close("distinct_count", "n"), F.lit(False))
    return sets.join(found, match, "left").select(*COMBINED, "field", F.col("level").cast("long").alias("level"), "n", holds.alias("holds"))


def p4_per_srcip_holds(spark: SparkSession, sf: str) -> DataFrame:
    """Per field: the groups (day, srcip) that have values, and how many of their counts are off by more than stated."""
    keys = ["day", *SRC, "field"]
    values = _identifiers(_with_day(spark, sf).where(present("srcip")), keys[:-1], ("dstip",)).where("a is not null and b is not null").distinct()
    exact = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = p4_per_srcip(spark, sf).withColumnsRenamed({c: f"_{c}" for c in keys})
    both = exact.join(found, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left")
    wrong = F.when(F.coalesce(_close("distinct_count", "n"), F.lit(False)), 0).otherwise(1)
    return both.groupBy("field").agg(F.count(F.lit(1)).alias("groups"), F.sum(wrong).alias("wrong"))


# ---- percentiles


DIGEST_GROUPS = ["day", "exporter_id", "proto"]
MEASURES = ["bytes", "packets", "duration"]
LIMITS = {"bytes": 5000, "packets": 60, "duration": 30000}


def _measured(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    """One row per flow record; negative measures become null and count nothing.  Records without day or proto are groups of their own."""
    rows = distinct_flows(_with_day(spark, sf), *DIGEST_GROUPS, *MEASURES).where(where)
    return stage(rows.select(*DIGEST_GROUPS, *[F.when(F.col(m) >= 0, F.col(m)).alias(m) for m in MEASURES]), "measured")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Groups whose median may reach the limit by their digests, settled by the counting pass.

    The upper bound of a median is never below it, and it is at least the limit exactly where fewer
    than half of the values lie below that.
    """
    rows = _measured(spark, sf, "day is not null and proto is not null")
    own = [*DIGEST_GROUPS, "field"]
    limit = F.coalesce(*[F.when(F.col("field") == m, F.lit(x)) for m, x in LIMITS.items()])
    medians = digest.quantile(digest.merge(digest.digests(rows, DIGEST_GROUPS, MEASURES), own), own, 0.5)
    candidates = stage(medians.where((F.col("n") >= 20) & (F.col("upper") >= limit)), "medians")
    certified = digest.certify(rows, candidates, DIGEST_GROUPS, MEASURES, probe=limit)
    return certified.where("2 * below_probe < n_exact").select(*own)


def p6_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per day, exporter and protocol with the rank error the second pass found."""
    rows = _measured(spark, sf)
    own = [*DIGEST_GROUPS, "field"]
    found = digest.quantile(digest.merge(digest.digests(rows, DIGEST_GROUPS, MEASURES), own), own, [0.25, 0.5, 0.75, 0.9, 0.99])
    return digest.certify(rows, stage(found, "quantiles"), DIGEST_GROUPS, MEASURES)


def p6_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Medians over all days per protocol, from the digests per day merged once more."""
    parts = digest.digests(_measured(spark, sf), DIGEST_GROUPS, MEASURES)
    daily = digest.merge(parts, [*DIGEST_GROUPS, "field"])
    return digest.quantile(digest.merge(daily, ["proto", "field"]), ["proto", "field"], 0.5)


def p6_ranks_hold(spark: SparkSession, sf: str) -> DataFrame:
    """The groups of p6_percentiles, their sizes, and whether the counted rank errors keep the bound."""
    found = p6_percentiles(spark, sf)
    return found.select(*DIGEST_GROUPS, "field", F.col("q").cast("double").alias("q"), F.col("n_exact").alias("n"), (F.col("rank_error") <= digest.rank_error()).alias("holds"))


def p6_weekly_holds(spark: SparkSession, sf: str) -> DataFrame:
    """The same of p6_weekly, whose digests were merged over days."""
    counted = digest.certify(_measured(spark, sf), stage(p6_weekly(spark, sf), "weekly"), ["proto"], MEASURES)
    return counted.select("proto", "field", F.col("n_exact").alias("n"), (F.col("rank_error") <= digest.rank_error(merges=2)).alias("holds"))


# ---- top N


def _bytes_per_pair(spark: SparkSession, sf: str) -> DataFrame:
    rows = distinct_flows(_with_day(spark, sf).where(present("srcip", "dstip") & F.col("day").isNotNull()), "day", *SRC, *DST, "bytes")
    return rows.groupBy("day", *SRC, *DST).agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    best = topn.top_n(_bytes_per_pair(spark, sf), ["day", *SRC], DST, "bytes", 3, more_than=3)
    return best.select("day", *SRC, *DST)


def p7_top10(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n(_bytes_per_pair(spark, sf), ["day", *SRC], DST, "bytes", 10)


ALL = (
    p2_found, p2_frequent, p2_intervals_hold, p4_found, p4_per_srcip, p4_per_srcip_holds, p4_combinations, p4_counts_hold, p4_srcip_combinations,
    p6_found, p6_percentiles, p6_ranks_hold, p6_weekly, p6_weekly_holds, p7_found, p7_top10,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


_HERE = "({x}_hi is not null and {x}_lo is not null and ({x}_hi <> 0 or {x}_lo <> 0))"
_SRC, _DST = _HERE.format(x="srcip"), _HERE.format(x="dstip")
_DAY = "cast(floor(first / 86400000) as bigint)"
_TOP = f"""
with f as (select distinct flow_id, {_DAY} as day, srcip_hi, srcip_lo, dstip_hi, dstip_lo, bytes from flow_records
           where {_SRC} and {_DST} and first is not null),
b as (select day, srcip_hi, srcip_lo, dstip_hi, dstip_lo, cast(sum(coalesce(bytes, 0)) as bigint) as bytes from f group by all),
r as (select *, row_number() over (partition by day, srcip_hi, srcip_lo order by bytes desc, dstip_hi, dstip_lo) as rank,
      count(*) over (partition by day, srcip_hi, srcip_lo) as c from b)
"""


def oracle_sql() -> dict[str, str]:
    def frequent(hi: str, lo: str, name: str, where: str) -> str:
        return (
            f"select '{name}' as field, cast({hi} as bigint) as value_hi, cast({lo} as bigint) as value_lo from f where {where} "
            f"group by all having count(*) * 100 >= (select count(*) from f)"
        )

    def distinct(name: str, value: str, where: str) -> str:
        return (
            f"select {_DAY} as day, srcip_hi, srcip_lo, '{name}' as field from flow_records where {_SRC} and {where} and first is not null "
            f"group by all having count(distinct {value}) >= 40"
        )

    def median(m: str) -> str:
        return (
            f"select day, exporter_id, proto, '{m}' as field from (select day, exporter_id, proto, count(*) as n, count(*) filter ({m} < {LIMITS[m]}) as low "
            f"from f where {m} >= 0 group by all) where n >= 20 and 2 * low < n"
        )

    fields = {"srcip": ("(srcip_hi, srcip_lo)", _SRC), "dstip": ("(dstip_hi, dstip_lo)", _DST), "dstport": ("dstport", "dstport is not null")}
    with_day = f"(select *, {_DAY} as day from flow_records)"
    sets = ", ".join("(" + ", ".join(own) + ")" for own in CHOICES)
    ranks = f"with f as (select distinct flow_id, {_DAY} as day, exporter_id, proto, bytes, packets, duration from flow_records) "
    return {
        "p2_intervals_hold": "with f as (select distinct flow_id, srcip_hi, srcip_lo, dstip_hi, dstip_lo, dstport from flow_records) "
        + " union all ".join(
            frequent(hi, lo, name, where).replace(" from f where", ", cast(count(*) as bigint) as n, true as holds from f where", 1)
            for hi, lo, name, where in (("srcip_hi", "srcip_lo", "srcip", _SRC), ("dstip_hi", "dstip_lo", "dstip", _DST), ("0", "dstport", "dstport", "dstport is not null"))
        ),
        "p4_counts_hold": " union all ".join(
            f"select day, exporter_id, proto, '{name}' as field, cast(16 * grouping(day) + 8 * grouping(exporter_id) + 4 * grouping(proto) as bigint) as level, "
            f"count(distinct {value}) as n, true as holds from {with_day} where {where} group by grouping sets ({sets})"
            for name, (value, where) in fields.items()
        ),
        "p4_per_srcip_holds": " union all ".join(
            f"select '{name}' as field, count(*) as groups, cast(0 as bigint) as wrong from (select distinct day, srcip_hi, srcip_lo from {with_day} where {_SRC} and {fields[name][1]})" for name in ("dstip", "dstport")
        ),
        "p6_ranks_hold": ranks
        + " union all ".join(
            f"select day, exporter_id, proto, '{m}' as field, q, count(*) as n, true as holds from f, (select unnest([0.25, 0.5, 0.75, 0.9, 0.99])::double as q) where {m} >= 0 group by all" for m in MEASURES
        ),
        "p6_weekly_holds": ranks + " union all ".join(f"select proto, '{m}' as field, count(*) as n, true as holds from f where {m} >= 0 group by all" for m in MEASURES),
        "p2_found": "with f as (select distinct flow_id, srcip_hi, srcip_lo, dstip_hi, dstip_lo, dstport from flow_records) "
        + " union all ".join([frequent("srcip_hi", "srcip_lo", "srcip", _SRC), frequent("dstip_hi", "dstip_lo", "dstip", _DST), frequent("0", "dstport", "dstport", "dstport is not null")]),
        "p4_found": distinct("dstip", "(dstip_hi, dstip_lo)", _DST) + " union all " + distinct("dstport", "dstport", "dstport is not null"),
        "p6_found": f"with f as (select distinct flow_id, {_DAY} as day, exporter_id, proto, bytes, packets, duration from flow_records "
        "where first is not null and proto is not null) " + " union all ".join(median(m) for m in MEASURES),
        "p7_found": _TOP + "select day, srcip_hi, srcip_lo, dstip_hi, dstip_lo from r where c > 3 and rank <= 3",
        "p7_top10": _TOP + "select day, srcip_hi, srcip_lo, dstip_hi, dstip_lo, bytes, cast(rank as integer) as rank from r where rank <= 10",
    }
