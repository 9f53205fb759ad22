import warnings

import pytest
from fixture_flows import SCHEMA, records
from pyspark.sql import functions as F

from flowloom.plans import summary
from flowloom.plans.filterlang import compile_filter
from flowloom.sources import store


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    df = spark.createDataFrame([*records(), (None, *records()[0][1:])], SCHEMA)
    store.write_store(df, path, distinct_addresses=1000)
    return path


def test_slots_are_pruned(spark, made):
    assert store.read_store(spark, made).count() == 1545
    begin = 1433222111 // 300 * 300
    some = store.read_store(spark, made, (begin + 300, begin + 600))
    assert 0 < some.count() == sum((begin + 300) * 1000 <= r[0] < (begin + 600) * 1000 for r in records())
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "slot" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_manifest_has_the_headers(spark, made):
    found = {r.field: r.asDict() for r in summary.metadata(store.read_manifest(spark, made)).collect()}
    assert found == {r.field: r.asDict() for r in summary.metadata_of_records(store.read_store(spark, made)).collect()}
    assert store.read_manifest(spark, made, (1433222100, 1433222400)).count() == 1


def test_bloom_filters_are_written_and_skip(spark, tmp_path):
    df = spark.range(0, 40_000, 2).select(F.lit(0).cast("long").alias("first"), *[F.col("id").alias(c) for c in store.ADDRESS_COLUMNS], *[F.lit(1).cast("long").alias(c) for c in ("flows", "packets", "bytes", "proto")])
    store.write_store(df.withColumn("srcip_hi", F.lit(0).cast("long")), str(tmp_path), distinct_addresses=50_000)
    rows = store.read_store(spark, str(tmp_path)).where(compile_filter("dst ip ::3039")).select("bytes")  # 12345 is odd: absent, but within min and max
    assert rows.count() == 0

    def metrics(plan):
        kids = plan.children()
        names = [x for i in range(kids.length()) for x in metrics(kids.apply(i))]
        return [plan, *names]

    rows = rows.where("dstip_hi = 12345")
    rows.collect()
    seen = [p.metrics().get("numOutputRows").get().value() for p in metrics(rows._jdf.queryExecution().executedPlan()) if "Scan" in p.nodeName()]
    assert seen in ([], [0])


def test_paths(spark, tmp_path):
    df = spark.createDataFrame(records()[:10], SCHEMA)
    for name in ("a", "a/deep/b", "c"):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    (tmp_path / "a" / "bfi.x.parquet").write_text("an index")
    (tmp_path / "a" / "broken.parquet").write_text("no parquet")
    (tmp_path / "a" / ".hidden.parquet").write_text("no parquet")
    (tmp_path / "a" / "notes").write_text("no parquet either")
    part = next((tmp_path / "c").glob("part*")).read_bytes()
    for odd in ("b.parquet", "bf.parquet", "bfi.parquet", "bfi", "flows.0", "_kept.parquet"):
        (tmp_path / "a" / odd).write_bytes(part)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        rows = store.read_paths(spark, [str(tmp_path / "a"), str(tmp_path / "none")], store.SCHEMA)
        assert rows.count() == 60 and any("none" in str(w.message) for w in caught)
        silent = store.warn_of_silent(spark, [str(tmp_path / "a"), str(tmp_path / "none")], rows)
        assert {s.rsplit("/", 1)[1] for s in silent} == {"broken.parquet", "notes", "_kept.parquet"}
        assert sum("corrupt" in str(w.message) for w in caught) == 2 and sum("underscore" in str(w.message) for w in caught) == 1
    assert store.read_paths(spark, [str(tmp_path / "a"), str(tmp_path / "c"), str(next((tmp_path / "c").glob("part*")))], store.SCHEMA).count() == 80
    assert store.read_paths(spark, [str(tmp_path / "c"), str(tmp_path / "c"), f"{tmp_path}/c/"]).count() == 30
    assert store.read_paths(spark, [str(tmp_path / "none")]).count() == 0
    with pytest.raises(ValueError):
        store.read_paths(spark, [])


def test_directives():
    import socket

    assert store.expand("/x/%h/y") == f"/x/{socket.gethostname()}/y"
    with pytest.warns(UserWarning):
        assert store.expand("/x/%q") is None
    with pytest.raises(ValueError):
        store.expand("%2:/x")
