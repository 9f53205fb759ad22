import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from oracle import both
from pyspark.sql import functions as F

from flowloom.llm import digest, lossy, queries, registers, topn

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    got, want = both(spark, sf, queries.queries()[name], SQL[name])
    assert got == want


# ---- lossy counting


def test_counts_lie_in_their_intervals_and_nothing_frequent_is_missing(spark):
    r = random.Random(2)
    values = [(1, 1)] * 900 + [(1, 2)] * 300 + [(None, 5)] * 100 + [(r.randrange(-5, 5), r.randrange(5000)) for _ in range(4000)]
    r.shuffle(values)
    df = spark.createDataFrame([(a, b, b, "x") for a, b in values], "a bigint, b bigint, p int, f string").repartition(5)
    error, support = 0.01, 0.05
    found = lossy.frequent(lossy.summaries(df, {"pair": ("a", "b"), "port": ("p",)}, error), support).collect()
    truth = {"pair": Counter(v for v in values if None not in v), "port": Counter((0, b) for _, b in values)}
    for x in found:
        true = truth[x.field][(x.value_hi, x.value_lo)]
        assert x.count_low <= true <= x.count_high <= x.count_low + error * len(values) + 5 and x.total == len(values)
    for field, counts in truth.items():
        assert {v for v, n in counts.items() if n >= support * len(values)} <= {(x.value_hi, x.value_lo) for x in found if x.field == field}


def test_steps_keep_the_bound_of_single_buckets():
    r = random.Random(4)
    rows = [min(int(r.paretovariate(0.7)), 500) for _ in range(3000)]
    kept, seen, width = None, 0, 20
    for i in range(0, len(rows), 70):
        before = seen // width
        seen += len(rows[i : i + 70])
        kept = lossy._step(kept, pa.table({"v": pa.array(rows[i : i + 70], pa.int64())}), before, seen // width)
    got = {x["v"]: (x["f"], x["delta"]) for x in kept.to_pylist()}
    for v, n in Counter(rows).items():
        f, delta = got.get(v, (0, seen // width))
        assert f <= n <= f + delta


def test_lossy_without_rows_or_values(spark):
    empty = spark.createDataFrame([], "p int")
    assert lossy.frequent(lossy.summaries(empty, {"port": ("p",)}, 0.01), 0.1).count() == 0
    nulls = spark.createDataFrame([(None,)] * 5, "p int")
    assert lossy.frequent(lossy.summaries(nulls, {"port": ("p",)}, 0.01), 0.1).count() == 0


# ---- registers


@pytest.mark.parametrize("n", [0, 1, 40, 3000, 60000])
def test_estimates_within_their_error(spark, n):
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), F.lit(1).alias("rank")).unionByName(spark.sql("select 7L g, cast(null as bigint) v, 1 as rank"))
    df = df.unionByName(df)  # repeats change nothing
    parts = registers.registers(df, ["g"], ["v"])
    whole = registers.estimate(registers.merge(parts, []), []).collect() if n else []
    for x in whole:
        assert abs(x.distinct_count - n) <= max(1, 4 * x.standard_error * n)
    by = {x.g: x.distinct_count for x in registers.estimate(parts, ["g"]).collect()}
    assert 7 not in by and all(abs(v - n / 2) <= max(1, 4 * registers.standard_error() * n / 2) for v in by.values())


def test_ranks_are_leading_zeros_plus_one(spark):
    p = 12
    hashes = [0, 1, 5, 2**51, 2**52 - 1, -1, 2**63 - 1, -(2**63), 12345678901234567]
    df = spark.createDataFrame([(h,) for h in hashes], "h bigint")
    for x in df.select("h", registers._rank(F.col("h"), p).alias("r")).collect():
        rest = (x.h % 2**64) & (2 ** (64 - p) - 1)
        assert x.r == 64 - p - rest.bit_length() + 1


def exact_counts(sf, always):
    """Distinct values by grouping of day, exporter_id and proto, each with ``always``; groups without values have no row."""
    here = lambda x: f"{x}_hi is not null and {x}_lo is not null and ({x}_hi <> 0 or {x}_lo <> 0)"
    values = {x: (f"({x}_hi, {x}_lo)", here(x)) for x in ("srcip", "dstip")} | {"dstport": ("dstport", "dstport is not null")}
    keys = ["day", "exporter_id", "proto"]
    out = {}
    for field, (value, where) in values.items():
        for own in itertools.product([True, False], repeat=3):
            columns = [*(k if used else f"null as {k}" for k, used in zip(keys, own)), *always]
            rows = duckdb.sql(
                f"select {', '.join(columns)}, count(distinct {value}) from (select *, cast(floor(first / 86400000) as bigint) as day from '{sf}/flow_records.parquet') "
                f"where {where} {'and ' + here('srcip') if always else ''} group by all"
            ).fetchall()
            level = sum(0 if used else bit for used, bit in zip(own, (16, 8, 4)))
            out |= {(*r[:-1], field, level): r[-1] for r in rows}
    return out


@pytest.mark.parametrize("name,always", [("p4_combinations", []), ("p4_srcip_combinations", ["srcip_hi", "srcip_lo"])])
def test_every_combination_counts_what_it_has(spark, sf, name, always):
    want = {k: n for k, n in exact_counts(sf, always).items() if not always or k[-2] != "srcip"}
    rows = queries.queries()[name](spark, sf).collect()
    got = {(x.day, x.exporter_id, x.proto, *[x[c] for c in always], x.field, x.level): x for x in rows}
    assert len(got) == len(rows) and got.keys() == want.keys()
    for k, x in got.items():
        assert x.standard_error == registers.standard_error() and abs(x.distinct_count - want[k]) <= max(1, 4 * x.standard_error * want[k])


def test_counts_per_day_and_srcip(spark, sf):
    want = {k[:1] + k[3:-1]: n for k, n in exact_counts(sf, ["srcip_hi", "srcip_lo"]).items() if k[-1] == 12 and k[-2] != "srcip"}
    rows = queries.queries()["p4_per_srcip"](spark, sf).collect()
    got = {(x.day, x.srcip_hi, x.srcip_lo, x.field): x for x in rows}
    assert len(got) == len(rows) and got.keys() == want.keys()
    for k, x in got.items():
        assert x.standard_error == registers.standard_error() and abs(x.distinct_count - want[k]) <= max(1, 4 * x.standard_error * want[k])


# ---- digests


def frame(spark, n=6000, seed=6):
    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 6 + ["b", None]), r.choice([None, 7.0, float("nan"), r.paretovariate(0.6), -r.random()]), i, 0.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v double, w int, q double").repartition(6)


def test_certified_ranks_within_bound(spark):
    rows, df = frame(spark)
    merged = digest.merge(digest.digests(df, ["g"], ["v", "w"]), ["g", "field"])
    quantiles = digest.quantile(merged, ["g", "field"], [0.01, 0.5, 0.99])
    values = defaultdict(list)
    for g, v, w, _ in rows:
        values[g, "w"].append(w)
        if v is not None and not math.isnan(v):
            values[g, "v"].append(v)
    found = digest.certify(df, quantiles.cache(), ["g"], ["v", "w"], probe=F.lit(7.0)).collect()
    assert len(found) == 3 * len(values)
    for x in found:
        own = values[x.g, x.field]
        assert x.n_exact == len(own) and x.below == sum(v < x.estimate for v in own) and x.upto == sum(v <= x.estimate for v in own)
        assert x.below_probe == sum(v < 7.0 for v in own)
        assert x.rank_error <= digest.rank_error()
    for x in quantiles.collect():
        own = sorted(values[x.g, x.field])
        assert x.lower <= own[max(math.ceil(x.q * len(own)), 1) - 1] <= x.upper and x.lower <= x.estimate <= x.upper


def test_salted_counting_agrees(spark, monkeypatch):
    _, df = frame(spark, 800)
    estimates = digest.quantile(digest.merge(digest.digests(df, ["g"], ["v"]), ["g", "field"]), ["g", "field"], 0.5).cache()
    plain = sorted(map(str, digest.certify(df, estimates, ["g"], ["v"]).collect()))
    monkeypatch.setattr(digest, "BROADCAST_GROUPS", 0)
    assert sorted(map(str, digest.certify(df, estimates, ["g"], ["v"]).collect())) == plain


def test_digests_stay_small_and_exact_for_few_values(spark):
    df = spark.range(100_000).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    merged = digest.merge(digest.digests(df.repartition(8), ["g"], ["v"]), ["g", "field"])
    assert merged.count() <= digest.DELTA + 1 and merged.agg(F.sum("weight")).first()[0] == 100_000
    few = spark.createDataFrame([(1, 5), (1, 5), (1, 9)], "g int, v int")
    assert digest.quantile(digest.merge(digest.digests(few, ["g"], ["v"]), ["g", "field"]), ["g", "field"], 0.5).first().estimate == 5.0
    none = few.limit(0)
    assert digest.quantile(digest.merge(digest.digests(none, ["g"], ["v"]), ["g", "field"]), ["g", "field"], 0.5).count() == 0


def test_records_without_day_or_proto_are_groups(spark, tmp_path):
    day_ms = 86_400_000
    groups = {(None, 6): 7, (3, None): 5, (None, None): 3, (3, 6): 9}
    rows = [(i * 100 + j, None if d is None else d * day_ms + j, 1, p, j, 1, 1) for i, ((d, p), n) in enumerate(groups.items()) for j in range(n)]
    pdf = spark.createDataFrame(rows, "flow_id bigint, first bigint, exporter_id int, proto smallint, bytes bigint, packets bigint, duration bigint")
    pdf.coalesce(1).write.parquet(str(tmp_path / "flow_records.parquet"))
    found = queries.queries()["p6_percentiles"](spark, str(tmp_path)).where("field = 'bytes' and q = 0.5").collect()
    assert {(x.day, x.proto): (x.n_exact, x.estimate) for x in found} == {k: (n, n // 2) for k, n in groups.items()}
    weekly = queries.queries()["p6_weekly"](spark, str(tmp_path)).where("field = 'bytes'").collect()
    assert {x.proto: x.n for x in weekly} == {6: 16, None: 8}


# ---- top N


def test_ties_nulls_and_small_groups(spark):
    rows = [("a", 3, 1, 5), ("a", 2, 1, 5), ("a", 1, None, 5), ("a", 1, 1, None), ("a", 9, 9, 7), ("b", 1, 1, 1), (None, 1, 1, 1), (None, 2, 1, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, i int, j int, s int, rank string")
    best = topn.top_n(df, ["g"], ["i", "j"], "s", 3)
    assert sorted((x.g or "", x.i, x.j or 0, x["rank"]) for x in best.collect()) == [("", 1, 1, 2), ("", 2, 1, 1), ("a", 1, 0, 2), ("a", 2, 1, 3), ("a", 9, 9, 1), ("b", 1, 1, 1)]
    assert {x.g for x in topn.top_n(df, ["g"], ["i", "j"], "s", 3, more_than=3).collect()} == {"a"}
    assert topn.top_n(df.limit(0), ["g"], ["i"], "s", 3, more_than=4).count() == 0


def test_group_limit_below_and_above_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id as i", "id * 7 % 11 as s")
    plan = topn.top_n(df, ["g"], ["i"], "s", 3, more_than=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# ---- more of registers, digests and counting at scale


@pytest.mark.parametrize("n", [9000, 10_000, 10_500, 11_000, 13_000, 16_000])
def test_the_stated_error_holds_where_registers_fill_up(spark, n):
    df = spark.range(n * 40).select((F.col("id") % 40).alias("g"), F.col("id").alias("v"))
    off = [x.distinct_count / n - 1 for x in registers.estimate(registers.registers(df, ["g"], ["v"]), ["g"]).collect()]
    assert len(off) == 40 and math.sqrt(sum(x * x for x in off) / 40) <= 1.1 * registers.standard_error()
    assert abs(sum(off) / 40) <= 0.6 * registers.standard_error()


def test_full_registers_and_largest_ranks(spark):
    rows = [("all", i, 12) for i in range(4096)] + [("top", i, 53 if i < 9 else 50) for i in range(4096)] + [("one", 7, 53)]
    found = {x.g: x.distinct_count for x in registers.estimate(spark.createDataFrame(rows, "g string, register int, rank byte"), ["g"]).collect()}
    assert abs(found["all"] / (4096 * 2**12 / (2 * math.log(2))) - 1) < 1e-9
    assert found["top"] > 4096 * 2**50 / 2 and abs(found["one"] - 1) < 0.01


def test_tasks_send_digests_on_when_they_have_many(monkeypatch):
    monkeypatch.setattr(digest, "STEP_ROWS", 100)
    monkeypatch.setattr(digest, "KEPT_ROWS", 150)
    r = random.Random(3)
    rows = [(r.choice([None, "hot", "hot", *map(str, range(200))]), r.randrange(50), float(r.randrange(9))) for _ in range(4000)]
    table = lambda xs: pa.table({"g": pa.array([x[0] for x in xs], pa.string()), "h": pa.array([x[1] for x in xs], pa.int64()), **{c: pa.array([x[2] for x in xs]) for c in ("mean", "lo", "hi")}, "weight": pa.array([1] * len(xs), pa.int64())})
    columns = ["g", "h", "mean", "weight", "lo", "hi"]
    parts = list(digest._folded(iter(table(rows).select(columns).to_batches(max_chunksize=60)), lambda t: t, ["g", "h"], 200))
    assert len(parts) > 10 and max(map(len, parts)) <= 500
    whole = pa.Table.from_batches(parts)
    assert sum(whole["weight"].to_pylist()) == len(rows)
    # the merge sees centroids sorted by group, and each group comes out in one go
    ordered = whole.sort_by([("g", "ascending"), ("h", "ascending")])
    done = [b.to_pylist() for b in digest._folded(iter(ordered.to_batches(max_chunksize=60)), lambda t: t, ["g", "h"], 200, True)]
    groups = [{(x["g"], x["h"]) for x in xs} for xs in done]
    assert len(done) > 10 and sum(map(len, groups)) == len(set.union(*groups)) == len({x[:2] for x in rows})
    counts = Counter()
    for xs in done:
        for x in xs:
            counts[x["g"], x["h"]] += x["weight"]
    assert counts == Counter(x[:2] for x in rows)


@pytest.mark.parametrize("order", ["random", "sorted"])
def test_bounds_hold_after_many_merges(spark, order):
    r = random.Random(12)
    values = [r.choice([0.0, r.expovariate(0.01), r.gauss(500, 20)]) for _ in range(20_000)]
    if order == "sorted":
        values.sort()
    df = spark.createDataFrame([(i * 16 // len(values), v) for i, v in enumerate(values)], "part int, v double").repartitionByRange(16, "part")
    parts = digest.merge(digest.digests(df, ["part"], ["v"], 50), ["part", "field"], 50)
    for by in (8, 4, 2, 1):  # binary merging, four more times
        parts = digest.merge(parts.withColumn("part", (F.col("part") % by).cast("int")), ["part", "field"], 50)
    values.sort()
    for x in digest.quantile(parts, ["part", "field"], [0.01, 0.25, 0.5, 0.9, 0.999]).collect():
        rank = max(math.ceil(x.q * len(values)), 1)
        assert x.n == len(values) and x.lower <= values[rank - 1] <= x.upper
        below, upto = sum(v < x.estimate for v in values), sum(v <= x.estimate for v in values)
        assert max(below + 1 - rank, rank - upto, 0) / len(values) <= digest.rank_error(50, 5)


def test_salts_spread_equal_values(spark, monkeypatch):
    monkeypatch.setattr(digest, "BROADCAST_GROUPS", 0)
    df = spark.range(64_000).select(F.lit(1).alias("g"), F.lit(0).alias("v"))
    estimates = digest.quantile(digest.merge(digest.digests(df, ["g"], ["v"]), ["g", "field"]), ["g", "field"], 0.5)
    plan = digest.certify(df, estimates, ["g"], ["v"])
    x = plan.first()
    assert x.n_exact == x.upto == 64_000 and x.below == 0 and "monotonically_increasing_id" in plan._jdf.queryExecution().analyzed().toString()


def test_counting_runs_once(spark, sf):
    plan = queries.queries()["p2_frequent"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # it ran when summaries were staged
