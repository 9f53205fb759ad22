import math
import random

import pytest

from flowloom.operators.balanced import hot_key_results, key_results


def quantile(xs, q):
    xs = sorted(x for x in xs if x is not None)
    return xs[max(math.ceil(q * len(xs)), 1) - 1] if xs else None


def data():
    r = random.Random(1)
    wide = [None, 0, -5, 2**63 - 1, -(2**63), 7, 7, 7]
    return [(r.choice(["hot"] * 8 + ["warm"] * 3 + [None] + [f"c{i}" for i in range(30)]), r.choice([1, 2]), r.choice([*wide, r.randrange(10**6)]), r.randrange(100)) for _ in range(1500)]


def expected(rows, q):
    by = {}
    for k, j, v, w in rows:
        if k is not None:
            by.setdefault((k, j), []).append((v, w))
    return {key: (len(xs), sum(w for _, w in xs), quantile([v for v, _ in xs], q), quantile([w for _, w in xs], q)) for key, xs in by.items()}


def test_both_ways_agree_with_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(*r, 0) for r in rows], "k string, j int, v bigint, w bigint, n int")
    for q, bins in ((0.5, 4096), (0.9, 16)):
        want = expected(rows, q)
        for share in (0.05, 1.0):
            got = {(x.k, x.j): (x.n, x.sum_w, x.q_v, x.q_w) for x in key_results(df, ["k", "j"], ["v", "w"], share, q, bins).collect()}
            assert got == want
        hot = {(x.k, x.j): (x.n, x.sum_w, x.q_v, x.q_w) for x in hot_key_results(df, ["k", "j"], ["v", "w"], 0.05, q, bins).collect()}
        assert hot == {k: v for k, v in want.items() if v[0] >= 0.05 * len(rows)} and hot


def test_empty_and_valueless(spark):
    df = spark.createDataFrame([], "k string, v bigint")
    assert key_results(df, ["k"], ["v"]).count() == hot_key_results(df, ["k"], ["v"], 0.01).count() == 0
    nothing = spark.createDataFrame([("a", None), ("a", None)], "k string, v bigint")
    assert [(x.n, x.sum_v, x.q_v) for x in hot_key_results(nothing, ["k"], ["v"], 0.5).collect()] == [(2, None, None)]


def test_cold_keys_keep_every_bit(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([("a", big), ("b", big), ("b", big + 2), ("b", -big), ("c", None)], "k string, v bigint")
    for share in (0.01, 1.0):
        assert {x.k: x.q_v for x in key_results(df, ["k"], ["v"], share).collect()} == {"a": big, "b": big, "c": None}


def test_no_buffer_holds_the_values_of_a_key(spark, tmp_path):
    spark.range(100).selectExpr("id % 7 as k", "id as v", "-id as w").write.parquet(str(tmp_path / "x"))
    plan = key_results(spark.read.parquet(str(tmp_path / "x")), ["k"], ["v", "w"], 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan and "row_number" in plan


def test_shares_out_of_range(spark):
    for share in (0, 1e-6, 1.5):
        with pytest.raises(ValueError):
            hot_key_results(spark.createDataFrame([("a", 1)], "k string, v bigint"), ["k"], ["v"], share)
