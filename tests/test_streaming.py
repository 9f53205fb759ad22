import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators.sessions import sessionize
from flowloom.streaming.sessions import in_calendar, stream_sessions, stream_totals

SCHEMA = "k string, id bigint, s bigint, d bigint, flows bigint, packets bigint, bytes bigint"


def rows(n=400, seed=2):
    r = random.Random(seed)
    out = [(r.choice(["a", "b", "c"]), i, r.randrange(0, 4_000_000), r.choice([None, 0, 500, 9000]), 1, 2, 3) for i in range(n)]
    return [*out, *out[:40]]


def feed(spark, tmp_path, batches):
    """A stream of one file per batch, read in order."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def results(spark, df, name):
    query = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_sessions_equal_the_batch_operator(spark, tmp_path):
    data = rows()
    random.Random(3).shuffle(data)  # as late as can be, but within the lateness
    last = [("end", 10**6, 10**9, 0, 1, 1, 1)]
    stream = feed(spark, tmp_path, [data[:200], data[200:], last, [("end", 10**6 + 1, 2 * 10**9, 0, 1, 1, 1)]])
    got = results(spark, stream_sessions(stream, ["k"], "s", "d", 60_000, "2 hours", identity="id"), "sessions").where("k <> 'end'")
    want = sessionize(spark.createDataFrame(data, SCHEMA), ["k"], "s", "d", 60_000, ["id"])
    columns = ["k", "session_start", "session_end", "events"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


@pytest.mark.parametrize("slide", [None, "5 minutes"])
def test_totals(spark, tmp_path, slide):
    data = rows()
    stream = feed(spark, tmp_path, [data[:150], data[150:], [("end", 0, 10**9, 0, 1, 1, 1)], [("end", 0, 2 * 10**9, 0, 1, 1, 1)]])
    got = results(spark, stream_totals(stream, ["k"], "s", "10 minutes", "2 hours", slide), f"totals{bool(slide)}").where("k <> 'end'").collect()
    step = 300_000 if slide else 600_000
    want = {}
    for k, _, s, _, f, p, b in data:
        start = s // step * step
        while start > s - 600_000:
            x = want.setdefault((start, start + 600_000, k), [0, 0, 0])
            x[0], x[1], x[2] = x[0] + f, x[1] + p, x[2] + b
            start -= step
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == want


def test_late_events_bridge_too_late_ones_are_dropped_and_far_clocks_are_rejects(spark, tmp_path):
    row = lambda k, i, s, d=0: (k, i, s, d, 1, 1, 1)
    far = [row("a", 90, 9_100_000_000_000_000_000), row("a", 91, -9_100_000_000_000_000_000), row("a", 92, None)]
    batches = [
        [row("a", 1, 1000), row("a", 2, 1020), *far],
        [row("a", 3, 1010), row("z", 4, 1500)],  # late: touches both
        [row("z", 5, 1501)],
        [row("a", 6, 1005)],  # the watermark is at 1400
        [row("z", 7, 10**6)],
        [row("z", 8, 2 * 10**6)],
    ]
    stream = feed(spark, tmp_path, batches)
    got = results(spark, stream_sessions(stream, ["k"], "s", "d", 10, "100 milliseconds", identity="id"), "late").where("k = 'a'")
    assert [(x.session_start, x.session_end, x.events) for x in got.collect()] == [(1000, 1020, 3)]
    rejected = spark.createDataFrame(batches[0], SCHEMA).where(~in_calendar(F.col("s")))
    assert sorted(x.id for x in rejected.collect()) == [90, 91, 92]


def test_totals_of_far_clocks(spark, tmp_path):
    stream = feed(spark, tmp_path, [[("a", 1, 5, 0, 1, 2, 3), ("a", 2, 9 * 10**18, 0, 1, 2, 3)], [("a", 3, 10**7, 0, 1, 2, 3)], [("a", 4, 2 * 10**7, 0, 1, 2, 3)]])
    got = results(spark, stream_totals(stream, ["k"], "s", "10 minutes", "1 minute"), "far").where("window_start = 0").collect()
    assert [(x.window_end, x.flows, x.bytes) for x in got] == [(600_000, 1, 3)]


def test_a_long_event_ends_with_the_calendar(spark, tmp_path):
    stream = feed(spark, tmp_path, [[("a", 1, 5, 2**63 - 1, 1, 1, 1), ("a", 2, 10**12, 0, 1, 1, 1), ("b", 3, 5, 3, 1, 1, 1)], [("b", 4, 10**9, 0, 1, 1, 1)], [("b", 5, 2 * 10**9, 0, 1, 1, 1)]])
    got = results(spark, stream_sessions(stream, ["k"], "s", "d", 60_000, "1 minute"), "long").collect()
    assert ("b", 5, 8) in {(x.k, x.session_start, x.session_end) for x in got} and "a" not in {x.k for x in got}
