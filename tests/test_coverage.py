import random

from flowloom.operators.coverage import gaps, periods

SCHEMA = "k string, s bigint, d bigint, gap_start int, shard int"


def expected(rows):
    by = {}
    for k, s, d in rows:
        if k is not None and s is not None:
            by.setdefault(k, []).append((s, s + max(d or 0, 0)))
    found, holes = [], []
    for k, xs in by.items():
        xs.sort()
        a, b = xs[0]
        for s, e in xs[1:]:
            if s > b:
                found.append((k, a, b, b - a))
                holes.append((k, b, s))
                a, b = s, e
            b = max(b, e)
        found.append((k, a, b, b - a))
    return sorted(found), sorted(holes)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def test_against_brute_force_over_many_shards(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 5 + ["x", "y", None]), r.choice([None, *range(-900, 3000)]), r.choice([None, -3, 0, 0, 1, 4, 11, 300])) for _ in range(500)]
    rows += rows[:50]
    want, holes = expected(rows)
    df = frame(spark, rows)
    for shard in (7, 64, 100_000):
        assert sorted(tuple(x) for x in periods(df, ["k"], "s", "d", shard_ms=shard).collect()) == want
        assert sorted(tuple(x) for x in gaps(df, ["k"], "s", "d", shard_ms=shard).collect()) == holes
        some = [h for h in holes if 3 < h[2] - h[1] <= 20]
        assert sorted(tuple(x) for x in gaps(df, ["k"], "s", "d", 3, 20, shard_ms=shard).collect()) == some


def test_touching_at_a_shard_edge_is_one_period(spark):
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20, 0), ("a", 21, 5)]
    df = frame(spark, rows)
    assert [tuple(x)[1:3] for x in periods(df, ["k"], "s", "d", shard_ms=10).orderBy("period_start").collect()] == [(0, 20), (21, 26)]
    assert [tuple(x) for x in gaps(df, ["k"], "s", "d", shard_ms=10).collect()] == [("a", 20, 21)]


def test_endless_intervals_and_empty_tables(spark):
    df = frame(spark, [("a", 0, 2**63 - 1), ("a", 500, 1), ("b", 2**62, 2**63 - 1), ("b", 0, 1), ("c", None, 3)])
    assert sorted(tuple(x)[:3] for x in periods(df, ["k"], "s", "d", shard_ms=10).collect()) == [("a", 0, 2**63 - 1), ("b", 0, 1), ("b", 2**62, 2**63 - 1)]
    assert [tuple(x) for x in gaps(df, ["k"], "s", "d", shard_ms=10).collect()] == [("b", 1, 2**62)]
    empty = frame(spark, [])
    assert periods(empty, ["k"], "s", "d").count() == gaps(empty, ["k"], "s", "d").count() == 0


def test_a_bad_clock_and_starts_at_both_ends(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [("a", low, 4), ("a", high, 9), ("a", high - 3, 1), ("a", 0, 5), ("a", 1_700_000_000_000, 10), ("b", low, high), ("b", -1, 0), ("c", high, None), ("c", low, None)]
    want, holes = expected([(k, s, min(d or 0, high - s)) for k, s, d in rows])
    df = frame(spark, rows)
    assert sorted(tuple(x)[:3] for x in periods(df, ["k"], "s", "d").collect()) == [w[:3] for w in want]
    assert max(x.period_duration for x in periods(df, ["k"], "s", "d").collect()) == high
    assert sorted(tuple(x) for x in gaps(df, ["k"], "s", "d").collect()) == holes
    assert [tuple(x) for x in gaps(df, ["k"], "s", "d", 0, 10).collect()] == [("a", high - 2, high)]


def test_long_intervals_cover_what_is_inside_later_shards(spark):
    rows = [("a", 0, 1000), ("a", 210, 3), ("a", 250, 2), ("a", 990, 30), ("a", 1030, 1), ("a", 1050, 1)]
    df = frame(spark, rows)
    assert sorted(tuple(x) for x in gaps(df, ["k"], "s", "d", shard_ms=100).collect()) == [("a", 1020, 1030), ("a", 1031, 1050)]
    assert sorted(tuple(x)[1:3] for x in periods(df, ["k"], "s", "d", shard_ms=100).collect()) == [(0, 1020), (1030, 1031), (1050, 1051)]


def test_a_pair_with_a_third_of_all_rows(spark):
    r = random.Random(8)
    rows = [("hot" if i % 3 == 0 else f"k{i % 400}", r.randrange(0, 10**7), r.choice([0, 50, 4000])) for i in range(6000)]
    want, holes = expected(rows)
    df = frame(spark, rows)
    assert sorted(tuple(x) for x in gaps(df, ["k"], "s", "d", shard_ms=100_000).collect()) == holes
    assert sorted(tuple(x) for x in periods(df, ["k"], "s", "d", shard_ms=100_000).collect()) == want


def test_the_pieces_are_sorted_once_and_the_stitch_has_a_row_per_shard(spark, tmp_path):
    frame(spark, [("a", 0, 1)]).write.parquet(str(tmp_path / "x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = gaps(spark.read.parquet(str(tmp_path / "x")), ["k"], "s", "d")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Generate" not in plan and "collect_list" not in plan
    assert plan.count("ReusedExchange") == 1 and plan.count("- Exchange hashpartitioning") == 3 and plan.count("Sort [") == 3
