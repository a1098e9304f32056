"""Where cuts go, and that what operators wrote can be taken away again."""

import os
from types import SimpleNamespace

import pytest

from stepweave.plans import durable


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="app")
    with pytest.raises(durable.NoSharedFolder):
        durable.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_the_folder_that_is_named_is_used():
    seen = []
    conf = SimpleNamespace(get=lambda *_: "s3a://bucket/cuts/")
    context = SimpleNamespace(getConf=lambda: conf, master="yarn", applicationId="app", getCheckpointDir=lambda: None, setCheckpointDir=seen.append)
    assert durable.shared_dir(SimpleNamespace(sparkContext=context, conf=conf)) == "s3a://bucket/cuts" and seen == ["s3a://bucket/cuts/"]


def test_own_files_are_tidied(spark):
    paths = [durable.fresh_path(spark, "test") for _ in range(2)]
    for path in paths:
        spark.range(3).write.parquet(path)
    durable.discard(spark, paths[0])
    assert [os.path.exists(p.removeprefix("file://")) for p in paths] == [False, True]
    assert durable.tidy(spark) >= 1 and not os.path.exists(paths[1].removeprefix("file://"))
