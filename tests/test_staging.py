import os
from types import SimpleNamespace

import pytest

from flowloom import staging


def test_staged_tables_are_kept_until_their_block_ends(spark):
    with staging.staged_within(spark):
        kept = staging.stage(spark.range(5), "x")
        path = staging._PATHS[-1].removeprefix("file://")
        assert kept.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path) and path not in staging._PATHS


def test_a_cluster_without_a_shared_folder_is_refused():
    fake = lambda master: SimpleNamespace(
        conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master, applicationId=master, getConf=lambda: SimpleNamespace(get=lambda *a: None))
    )
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            staging.shared_folder(fake(master))
    assert staging.shared_folder(fake("local[2]")).startswith("file:///")
