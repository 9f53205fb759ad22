import random

import pytest

from flowloom.operators.sessions import advance, sessionize

SCHEMA = "k string, id bigint, s bigint, d bigint, session_start string"


def expected(rows, gap):
    seen, by = set(), {}
    for k, i, s, d in rows:
        if k is None or s is None or (k, i, s, d) in seen:
            continue
        seen.add((k, i, s, d))
        by.setdefault(k, []).append((s, s + max(d or 0, 0)))
    out = []
    for k, xs in by.items():
        xs.sort()
        now = None
        for s, e in xs:
            if now and s - now[1] <= gap:
                now[1], now[2] = max(now[1], e), now[2] + 1
            else:
                now = [s, e, 1]
                out.append((k, now))
    return sorted((k, s, e, e - s, n) for k, (s, e, n) in out)


def run(spark, rows, gap, **more):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in sessionize(df, ["k"], "s", "d", gap, ["id"], **more).collect())


def test_gap_is_inclusive_and_copies_count_once(spark):
    rows = [("a", 1, 0, 10), ("a", 1, 0, 10), ("a", 2, 110, 5), ("a", 3, 216, None), ("b", 4, 5, -7), (None, 5, 0, 1), ("a", 6, None, 1)]
    assert run(spark, rows, 100) == [("a", 0, 115, 115, 2), ("a", 216, 216, 0, 1), ("b", 5, 5, 0, 1)]


def test_a_gap_of_zero_joins_touching_events_only(spark):
    assert run(spark, [("a", 1, 0, 5), ("a", 2, 5, 5), ("a", 3, 11, 0), ("a", 4, 11, 0)], 0) == [("a", 0, 10, 10, 2), ("a", 11, 11, 0, 2)]


def test_against_brute_force_with_small_shards(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "x", "y", None]), i, r.choice([None, *range(-2000, 2000, 7)]), r.choice([None, -3, 0, 5, 60, 900])) for i in range(800)]
    rows += rows[:100]
    for gap in (1, 20):
        assert run(spark, rows, gap, shard_ms=50) == expected(rows, gap)


def test_extremes_and_empty_tables(spark):
    assert run(spark, [], 10) == []
    top = 2**63 - 1
    found = run(spark, [("a", 1, top, top), ("a", 2, 0, 1), ("a", 3, -(2**63), 3)], 10)
    assert [(s, e) for _, s, e, _, _ in found] == [(-(2**63), -(2**63) + 3), (0, 1), (top, top)]


def test_far_starts_stay_apart(spark):
    far = 10**17
    rows = [("a", 1, far, 0), ("a", 2, 2 * far, 0), ("a", 3, 2 * far + 60_000, 0), ("a", 4, -(2**63), 0), ("a", 5, 2**63 - 1, 5)]
    assert [(s, e, n) for _, s, e, _, n in run(spark, rows, 60_000)] == [(-(2**63), -(2**63), 1), (far, far, 1), (2 * far, 2 * far + 60_000, 2), (2**63 - 1, 2**63 - 1, 1)]


def test_deliveries_with_late_events(spark):
    keys, gap, lateness = ["k"], 10, 100
    deliveries = [
        [("a", 1, 30, 0), ("a", 2, 50, 0), ("b", 3, 130, 5)],
        [("a", 4, 40, 0), ("a", 5, 31, 0), ("a", 6, 300, 0)],  # 40 is late and bridges 30 and 50; 31 lies just behind the mark
        [("a", 7, 150, 0), ("a", 8, 201, 0), ("b", 9, 160, 1), ("a", 10, 200, 0)],  # all but 201 are not behind 200: too late
    ]
    state, before, top, out = None, None, None, []
    for d in deliveries:
        df = spark.createDataFrame([(*r, "x") for r in d], SCHEMA)
        top = max([r[2] for r in d] + ([top] if top is not None else []))
        closed, state = advance(state, df, keys, "s", "d", gap, before, top - lateness)
        out += closed.collect()
        state = spark.createDataFrame(state.collect(), state.schema)
        before = top - lateness
    out += advance(state, df.limit(0), keys, "s", "d", gap, before, None)[0].collect()
    kept = [r for i, d in enumerate(deliveries) for r in d if i < 2 or r[2] > 200]
    assert sorted(map(tuple, out)) == expected(kept, gap)
    assert ("a", 30, 50, 20, 4) in [tuple(x) for x in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_deliveries_add_up_to_all_at_once(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("aab"), i, r.randrange(0, 3000), r.choice([None, 0, 8])) for i in range(300)]
    rows.sort(key=lambda x: x[2] + r.randrange(0, 200))
    state, before, out = None, None, []
    for i in range(0, 300, 100):
        df = spark.createDataFrame([(*x, "x") for x in rows[i : i + 100]], SCHEMA)
        mark = max(x[2] for x in rows[: i + 100]) - 250
        closed, state = advance(state, df, ["k"], "s", "d", 15, before, mark, shard_ms=64)
        out, before = out + closed.collect(), mark
        assert all(x.session_end + 15 <= mark for x in closed.collect())
        state = spark.createDataFrame(state.collect(), state.schema)
    out += state.collect()
    assert sorted(map(tuple, out)) == expected(rows, 15)
